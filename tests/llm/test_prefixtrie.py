import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from retenta.llm import prefixtrie, turns
from .conftest import rows
from .talk import SCHEMA, conversations, in_turn

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(data):
    own = {c: [(r or "", x or "") for r, x in v] for c, v in in_turn(data).items() if c is not None}
    path = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        of = c - (c % 5 if c >= 0 else -(-c % 5))
        path[c] = tuple(own.get(of, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in path.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        size = len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * size
            leaves[p[:d]] += not children[p]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(path[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("leaf", [4, 1])
def test_matches_brute_force(spark, leaf):
    data = conversations()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    assert rows(prefixtrie.prefix_trie(df, leaf), *COLUMNS) == brute(data)


def test_ids_of_one_end_are_joined_over_runs(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "ID_BITS", 2)
    data = conversations()
    assert rows(prefixtrie.prefix_trie(spark.createDataFrame(data, SCHEMA)), *COLUMNS) == brute(data)


def test_numbers_go_on_across_ranges(spark):
    data = conversations()
    got = turns.in_order(spark.createDataFrame(data, SCHEMA)).collect()
    want = in_turn(data)
    numbered = defaultdict(dict)
    for r in got:
        numbered[r["conv_id"]][r["at"]] = (r["role"], r["text"])
    assert {c: [v[i] for i in range(len(v))] for c, v in numbered.items()} == want


def test_empty(spark):
    assert prefixtrie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
