import collections
import hashlib
import random

import pytest

from retenta.llm import suffixdedup
from .conftest import rows


def brute(data, width):
    starts = collections.Counter(b[i:i + width] for _, b in data for i in range(len(b) - width + 1))
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if starts[b[i:i + width]] > 1:
                gone[i:i + width] = b"\1" * width
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: [(x is not None, x) for x in r])


def test_suffix_array_is_sorted():
    rng = random.Random(3)
    for _ in range(400):
        d = bytes(rng.choice(b"ab\xffc") for _ in range(rng.randint(0, 50)))
        assert suffixdedup.suffix_array(d, 60).tolist() == sorted(range(len(d)), key=lambda i: d[i:])


def test_repeats_of_segments():
    segments = [b"xxabcdefyy", b"zabcdefz", b"abcd"]
    assert [x.tolist() for x in suffixdedup.repeats(segments, 5)] == [[2, 3], [1, 2], []]
    assert [x.tolist() for x in suffixdedup.repeats([b"aaaaaa"], 3)] == [[0, 1, 2, 3]]


@pytest.mark.parametrize("crowd", [256, 2])
def test_removals_match_brute_force(spark, docs, crowd, monkeypatch):
    monkeypatch.setattr(suffixdedup.removals, "__defaults__", (400, 64, 200, crowd, 1 << 19, 1 << 16))
    rng = random.Random(8)
    shared = "".join(rng.choice("abc é\n") for _ in range(1500))
    extra = [(200 + i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 200)))
              + shared[rng.randint(0, 700):rng.randint(800, 1500)]) for i in range(40)]
    extra += [(300, "q" * 401), (301, "r" * 399), (302, "ab" * 700)]
    both = docs.select("doc_id", "text").filter("doc_id is null or doc_id <> 103").unionByName(
        spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows(suffixdedup.deduplicate(both), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in both.collect()]
    assert got == brute(data, 400)


@pytest.mark.parametrize("chunk,piece", [(700, 300), (1 << 19, 1 << 16)])
def test_texts_of_many_chunks_match_brute_force(spark, chunk, piece, monkeypatch):
    monkeypatch.setattr(suffixdedup.removals, "__defaults__", (400, 64, 200, 256, chunk, piece))
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, long = make(900), make(9000)
    near = [list(passage) for _ in range(12)]
    for i, t in enumerate(near):
        t[(i * 71) % 900] = "!"
    data = [(1, long), (2, long[2000:3100] + passage), (3, make(1500) + long[8000:] + passage + make(50)), (4, long), (5, make(3000)),
            (6, "a" * 1300), *((10 + i, make(20) + "".join(t)) for i, t in enumerate(near))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = rows(suffixdedup.deduplicate(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute([(d, t.encode()) for d, t in data], 400)


def test_crowded_cores_of_near_copies(spark):
    # Copies of one passage with a changed sign each, cut at many places: crowded at every cut, and clipped differently.
    rng = random.Random(6)
    base = "".join(rng.choice("abcdefgh ") for _ in range(640))
    data = []
    for i in range(60):
        t = list(base)
        t[rng.choice((3, 100, 180, 440, 500, 630))] = rng.choice("XYZ")
        data.append((i, "".join(t)[rng.randint(0, 90):rng.randint(560, 640)]))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    want = brute([(d, t.encode()) for d, t in data], 400)
    for crowd in (1, 4, 256):
        texts, ranges = suffixdedup.removals(docs, crowd=crowd)
        by = {}
        for r in ranges.collect():
            by.setdefault((r["__k1"], r["__k2"]), []).append((r["lo"], r["hi"]))
        got = {r["text"]: suffixdedup.kept_bytes(r["text"], by.get((r["__k1"], r["__k2"]), []))[1:] for r in texts.collect()}
        assert [got[t] for _, t in data] == [w[2:4] for w in want]


def test_a_span_has_one_range(spark):
    # Near copies whose repeated starts lie apart: a range each would be joined to every occurrence of a segment.
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefgh ") for _ in range(900))
    texts = []
    for i in range(80):
        t = list(base)
        for at in rng.sample((5, 120, 410, 455, 500, 780, 890), 3):
            t[at] = rng.choice("XYZ")
        texts.append("".join(t))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    total = sum(len(suffixdedup.spans([t.encode()], 400, 64, 200)[0]) for t in texts)
    want = brute([(d, t.encode()) for d, t in enumerate(texts)], 400)
    for crowd in (1, 4, 256):
        _, ranges = suffixdedup.removals(docs, crowd=crowd)
        assert 0 < ranges.count() <= total
    assert rows(suffixdedup.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_planted_passages_all_go_and_clean_texts_stay(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(90) for _ in range(10)]
    data = [(i, f"{say(60)} {passages[i % 10]} {say(60)}") for i in range(60)] + [(100 + i, say(200)) for i in range(40)]
    got = {r["doc_id"]: r["n_removed"] for r in suffixdedup.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert all(len(passages[d % 10]) <= got[d] <= len(passages[d % 10]) + 4 for d in range(60))       # recall 1.0
    assert all(got[100 + i] == 0 for i in range(40))


def test_long_texts_are_cut_without_loss():
    pieces = list(suffixdedup._cut(["abcdefghij"], 4, 3))
    assert [(at, p) for _, at, p in pieces] == [(0, b"abcdef"), (3, b"defghi"), (6, b"ghij")]


def test_empty(none):
    assert suffixdedup.deduplicate(none).count() == 0
