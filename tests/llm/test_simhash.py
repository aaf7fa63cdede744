import random

import xxhash

from retenta.llm import components, simhash
from .conftest import rows


def brute_fingerprint(text):
    words = [w for w in _split((text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _split(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out, word = [], ""
    for c in low + " ":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute_components(fps, ids, radius=2):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                top[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(docs):
    got = rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    data = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fps = [brute_fingerprint(t) for _, t in data]
    comps = brute_components(fps, [d for d, _ in data])
    want = [(d, f"{f:016x}", c) for (d, _), f, c in zip(data, fps, comps)]
    assert got == sorted(want, key=lambda r: [(x is not None, x) for x in r])


def test_crowded_shards_lose_no_link(spark):
    rng = random.Random(2)
    fps = {0, (1 << 64) - 1}
    for base in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for shard in (3, 10_000):
        roots = dict(rows(components.components(simhash.links(df, shard=shard)), "node", "root"))
        got = [roots.get(x, x) for x in signed]
        want = brute_components(fps, list(range(len(fps))))
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(4)
    tree, held = simhash.BKTree(), set()
    assert tree.search(5, 2) == []
    for _ in range(300):
        x = rng.getrandbits(10)
        assert sorted(tree.search(x, 2)) == sorted(y for y in held if (x ^ y).bit_count() <= 2)
        tree.add(x)
        held.add(x)


def test_components_of_long_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(-40, 60)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long")), "node", "root"))
    assert got == {**{i: -40 for i in range(-40, 61)}, 100: 100, 101: 100}


def test_one_of_each_keeps_columns_and_one_row_per_component(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    comps = {c for _, c in rows(simhash.near_duplicates(docs), "doc_id", "component_id")}
    ids = [d for (d,) in rows(kept, "doc_id")]
    assert set(ids) == comps and len(ids) == len(comps) + 1   # id 8 has two unlike texts


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0
