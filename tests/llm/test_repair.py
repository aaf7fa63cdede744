import hashlib
import itertools
import re
import zlib

import pytest

from retenta.llm import repair
from .conftest import rows
from .talk import SCHEMA, conversations, in_turn

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FORM = re.compile(r"(s?(ua)+)?")


def lightest(told):
    """A dynamic program over rows and states that carries whole (cost, audit, turns)."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def with_inserts(t):
        for _ in range(4):
            for state, (cost, audit, made) in list(t.items()):
                want = "a" if state == "u" else "u"
                new = cost + 5, audit + "I", made + [({"a": "assistant", "u": "user"}[want], "")]
                if want not in t or new[:2] < t[want][:2]:
                    t[want] = new
        return t

    t = with_inserts({"": (0, "", [])})
    for role, text, fault in told:
        new = {}

        def put(state, value):
            if state not in new or value[:2] < new[state][:2]:
                new[state] = value

        for state, (cost, audit, made) in t.items():
            put(state, (cost + 2, audit + "D", made))
            if fault in ("blank", "duplicate"):
                continue
            cost += 5 * (fault == "truncated")
            want = "a" if state == "u" else "u"
            put(want, (cost + 1, audit + "R", made + [({"a": "assistant", "u": "user"}[want], text)]))
            if (state, role[:1]) in after:
                put(after[state, role[:1]], (cost, audit + "K", made + [(role, text)]))
        t = with_inserts(new)
    return min((t[s] for s in ("", "a") if s in t), key=lambda v: v[:2])


def brute(data):
    harmed = []
    for c, t, r, x, *_ in data:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        harmed += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out, left = [], in_turn(harmed)
    for c in {r[0] for r in data}:
        seen, told = set(), []
        for r, x in left.get(c, []):
            shown = x.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not shown else "duplicate" if (r, x) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((r, x))
            told.append((r, x, fault))
        numbers = [t for k, t, *_ in harmed if k == c and t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        cost, audit, made = lightest(told)
        assert FORM.fullmatch("".join(r[:1] for r, _ in made))
        faults = [f for *_, f in told]
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("segment", [64, 3])
def test_matches_brute_force(spark, segment):
    data = conversations()
    assert rows(repair.report(spark.createDataFrame(data, SCHEMA).repartition(4), segment), *COLUMNS) == brute(data)


def test_agenda_equals_all_edit_scripts():
    """Every script of at most three inserts, over all short conversations, against the agenda."""
    for kinds in (k for n in range(4) for k in itertools.product("suax", repeat=n)):
        for faults in itertools.product(".dt", repeat=len(kinds)):
            best = {}
            stack = [(0, "", 0, repair.NOTHING)]
            while stack:
                cost, audit, used, state = stack.pop()
                if used == len(kinds):
                    best[state] = min(best.get(state, (99, "")), (cost, audit))
                want = repair.WANTED[state]
                if audit.count("I") < 3:
                    stack.append((cost + 5, audit + "I", used, repair.NEXT[state, want]))
                if used < len(kinds):
                    stack.append((cost + 2, audit + "D", used + 1, state))
                    if faults[used] != "d":
                        more = cost + 5 * (faults[used] == "t")
                        stack.append((more + 1, audit + "R", used + 1, repair.NEXT[state, want]))
                        if (state, kinds[used]) in repair.NEXT:
                            stack.append((more, audit + "K", used + 1, repair.NEXT[state, kinds[used]]))
            got = repair.derivations("".join(kinds), "".join(faults), repair.NOTHING)
            assert {s: got[s] for s in best} == best


def test_repaired_turns_alternate(spark):
    data = conversations()
    turns = repair.diagnosed(repair.in_order(repair.damaged(spark.createDataFrame(data, SCHEMA))))
    costs, repaired, _ = repair.repair(turns)
    found = {}
    for r in sorted(repaired.collect(), key=lambda r: (r["seg"], r["step"])):
        found[r["conv_id"]] = found.get(r["conv_id"], "") + r["role"][:1]
    assert found and all(FORM.fullmatch(x) for x in found.values())
    assert {r["conv_id"] for r in costs.collect()} >= set(found)


def test_empty(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0
