import itertools
import math

import numpy as np
import pytest

from retenta.llm import langid
from retenta.llm.common import table
from .conftest import rows

SF = "/root/testdata/sf0.01"


def ways(word, vocabulary):
    """All segmentations of the marked word into pieces or single unknown signs."""
    marked = langid.MARK + word
    n = len(marked)
    for cuts in itertools.product((0, 1), repeat=n - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [n]
        parts = [marked[a:b] for a, b in zip([0, *ends], ends)]
        yield from itertools.product(*[[vocabulary[p]] * (p in vocabulary) + [len(vocabulary)] * (len(p) == 1)
                                       if p in vocabulary else [len(vocabulary)] * (len(p) == 1) for p in parts])


def brute(word, vocabulary, p):
    return [sum(math.prod(p[i][c] for i in way) for way in ways(word, vocabulary)) for c in range(len(p[0]))]


@pytest.fixture(scope="module")
def small():
    names = ["a", "b", "ab", "ba", langid.MARK + "a", langid.MARK + "ab", "bab"]
    vocabulary = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(1)
    p = rng.random((len(names) + 2, 2))
    p[-1] = 0
    return vocabulary, p


def test_forward_sums_all_segmentations(small):
    vocabulary, p = small
    for word in ("a", "ab", "abab", "bbab", "xab", "abxba"):
        got = langid.Lattice(vocabulary).forward([word], p)[-1][0]
        assert got == pytest.approx(brute(word, vocabulary, p))


def test_expected_counts_match_enumeration(small):
    vocabulary, p = small
    word, times = "abab", 3.0
    want = np.zeros(len(vocabulary) + 1)
    total = brute(word, vocabulary, p)[0]
    for way in ways(word, vocabulary):
        for i in way:
            want[i] += times * math.prod(p[j][0] for j in way) / total
    assert langid.Lattice(vocabulary).expected([word], np.array([times]), p[:, :1]) == pytest.approx(want)


def test_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = rows(langid.identify(docs), "doc_id", "held_out", "lang_pred", "score")
    langs = dict(rows(docs, "doc_id", "lang"))
    held = [(langs[d], p) for d, h, p, _ in got if h]
    assert len(got) == docs.count() and len(held) > 100
    assert np.mean([a == b for a, b in held]) >= 0.97 and all(0 <= s <= 1 for *_, s in got)


def test_nulls_and_empty_tables(spark, docs, none):
    got = langid.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    by_id = {d: (p, s) for d, p, s in rows(got, "doc_id", "lang_pred", "score")}
    assert by_id[100] == by_id[101] == by_id[102] == ("und", 0.0) and by_id[104][0] == "en"
    assert langid.identify(none).count() == 0
    assert {p for (p,) in rows(langid.identify(docs.filter("lang is null")), "lang_pred")} == {"und"}
