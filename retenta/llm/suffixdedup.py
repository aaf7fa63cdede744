"""Removal of repeated 400-byte strings with suffix arrays built by two-stage sorting.

A suffix array of a whole corpus fits no task, so strings are first dealt to
groups such that equal ones meet. Every start of a string is described by the
anchor of its WIDTH bytes (the least hash of GRAM bytes, leftmost on ties) and
by its distance to it; starts of one anchor form a run, cut into spans of at most STEP starts at fixed
distances. All strings of a span cover the same core bytes, so equal strings
have equal cores. Only cores that occur more than once go on.

The text of a span, WIDTH - 1 bytes more than its starts, is a segment. Equal
segments are one class with a count. The segments of a core are sorted in one
suffix array: suffixes smaller than their successors directly, all others
induced from them by bucket scans; neighbours with a common prefix of WIDTH
bytes are repeats. A core of one class needs no sorting. A core of very many
classes is dealt again by parts with longer cores of their own, until each is small
enough to be sorted or is a single start, so no group is unbounded.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, shuffle_partitions, text_keys, written

WIDTH = 400
GRAM = 64
STEP = 200
CUTS = (50, 10, 2, 1)   # starts of a part of a crowded core, cut after cut
CHUNK = 1 << 19         # bytes of text looked at together
PIECE = 1 << 16         # starts of a piece of text from which segments are read
CROWD = 256             # classes of a core beyond which it is dealt again
BATCH = 1 << 16         # bytes of segments sorted together
BASE = 0x9E3779B97F4A7C15
_END = b"\xff"          # in no UTF-8 text


def suffix_array(data: bytes, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``data`` in order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    # A suffix is smaller than its successor if the next byte that differs is greater; the end is smallest.
    change = np.flatnonzero(np.append(b[1:] != b[:-1], True))
    nxt = change[np.searchsorted(change, np.arange(n))]
    smaller = (nxt + 1 < n) & (b[np.minimum(nxt + 1, n - 1)] > b)
    direct = sorted(np.flatnonzero(smaller).tolist(), key=lambda i: data[i:i + depth])
    ends = np.cumsum(np.bincount(b, minlength=256))
    order = [-1] * n
    place = np.array(direct, np.int64)
    first = b[place]
    sizes = np.bincount(first, minlength=256)
    offset = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)     # within a bucket
    for at, i in zip((ends[first] - sizes[first] + offset).tolist(), direct):
        order[at] = i
    head = (ends - np.bincount(b, minlength=256)).tolist()
    larger = (~smaller).tolist()
    j = n - 1                                    # the empty suffix comes first and induces the last byte
    order[head[data[j]]] = j
    head[data[j]] += 1
    for at in range(n):
        j = order[at] - 1
        if j >= 0 and larger[j]:
            c = data[j]
            order[head[c]] = j
            head[c] += 1
    return np.array(order, np.int64)


def repeats(segments: list[bytes], width: int) -> list[np.ndarray]:
    """For each segment the starts whose ``width`` bytes start elsewhere in the segments too."""
    data = _END.join(segments)
    starts = np.cumsum([0, *(len(s) + 1 for s in segments[:-1])])
    order = suffix_array(data, width + 1)
    owner = np.searchsorted(starts, order, "right") - 1
    room = starts[owner] + np.array([len(s) for s in segments])[owner] - order
    whole = order[room >= width].tolist()        # equal strings are neighbours among these
    found = set()
    for a, b in zip(whole, whole[1:]):
        if data[a:a + width] == data[b:b + width]:
            found.update((a, b))
    flagged = np.array(sorted(found), np.int64)
    of = np.searchsorted(starts, flagged, "right") - 1
    return [flagged[of == k] - starts[k] for k in range(len(segments))]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int):
    if not _POWERS or len(_POWERS[0][0]) < n:
        up = np.cumprod(np.append(np.uint64(1), np.full(n - 1, BASE, np.uint64)))
        down = np.cumprod(np.append(np.uint64(1), np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)))
        _POWERS[0] = up, down
    up, down = _POWERS[0]
    return up[:n], down[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def spans(pieces: list[bytes], width: int, gram: int, step: int):
    """(piece, first start, last start, core, segment hash, offset) arrays over pieces of text.

    offset: of the first start from the span's first possible one.
    """
    data = b"".join(pieces)
    n, none = len(data), tuple(np.zeros(0, np.int64) for _ in range(6))
    if n < width:
        return none
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    begins = np.cumsum(lengths) - lengths
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(np.frombuffer(data, np.uint8).astype(np.uint64) * up[:n], out=sums[1:])

    def hashed(at, size):                          # of data[at:at + size], for arrays of places
        return _mix((sums[at + size] - sums[at]) * down[at])

    window = width - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * down[:n - gram + 1])
    low = np.uint64(24)
    ranked = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    blocks = -(-len(ranked) // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(ranked)] = ranked
    tiled = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(tiled, axis=1).ravel()
    behind = np.minimum.accumulate(tiled[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    least = np.minimum(behind[:count], ahead[window - 1:window - 1 + count])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(count + 1, np.int64)
    some = lengths >= width
    np.add.at(valid, begins[some], 1)
    np.add.at(valid, np.minimum(begins[some] + lengths[some] - width + 1, count), -1)
    valid = np.cumsum(valid)[:count] > 0
    grade = (np.arange(count) - anchor - 1) // step
    name = np.where(valid, anchor * 1024 + grade + 512, -1)
    turn = name[1:] != name[:-1]
    opens, closes = np.append(True, turn) & valid, np.append(turn, True) & valid
    lo, hi = np.flatnonzero(opens), np.flatnonzero(closes)
    left = anchor[lo] + grade[lo] * step + 1      # the span's first possible start
    core = hashed(left + step - 1, width - step + 1) ^ grade[lo].astype(np.uint64)
    digest = xxhash.xxh3_64_intdigest
    segment = np.array([digest(data[a:b + width], a - c) for a, b, c in zip(lo.tolist(), hi.tolist(), left.tolist())], np.uint64)
    piece = np.searchsorted(begins, lo, "right") - 1
    # Empty pieces begin where others do; the last that begins there holds the place.
    return piece, lo - begins[piece], hi - begins[piece], core.view(np.int64), segment.view(np.int64), lo - left


def _cut(texts, width: int, size: int):
    """(row, offset, bytes) pieces: long texts in parts that overlap so that every start is in one."""
    for row, text in enumerate(texts):
        data = (text or "").encode("utf-8")
        for at in range(0, max(len(data) - width + 1, 0), size):
            yield row, at, data[at:at + size + width - 1]


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, str]:
    """__k1, __k2, text, copies: a bucketed table, so that texts are shuffled once; and its name."""
    spark = docs.sparkSession
    counted = docs.select(*text_keys(F.col("text")), F.coalesce("text", F.lit("")).alias("text")).groupBy(
        "__k1", "__k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    path = scratch_path(spark, "texts")
    name = "texts_" + path[-32:]
    (counted.write.bucketBy(shuffle_partitions(spark), "__k1", "__k2").option("path", path).saveAsTable(name))
    return spark.table(name), name


def removals(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, step: int = STEP, crowd: int = CROWD,
             chunk: int = CHUNK, piece: int = PIECE):
    """The table of distinct texts and, by __k1 and __k2, the byte ranges to remove (lo, hi exclusive; they may overlap)."""
    texts, _ = distinct_texts(docs)

    def describe(batches):
        names = ["__k1", "__k2", "n", "lo", "hi", "core", "segment", "off"]
        for pdf in batches:
            keys = [pdf[c].to_numpy() for c in ("__k1", "__k2", "copies")]
            held, size = [], 0

            def flush():
                piece, lo, hi, core, segment, off = spans([h[2] for h in held], width, gram, step)
                row = np.array([h[0] for h in held], np.int64)[piece]
                at = np.array([h[1] for h in held], np.int64)[piece]
                return pd.DataFrame(dict(zip(names, [k[row] for k in keys] + [lo + at, hi + at, core, segment, off])))

            for part in _cut(pdf["text"], width, chunk):
                held.append(part)
                size += len(part[2])
                if size >= chunk:
                    yield flush()
                    held, size = [], 0
            if held:
                yield flush()

    described = written(texts.mapInPandas(
        describe, "__k1 long, __k2 long, n long, lo long, hi long, core long, segment long, off long"), "spans")
    cores = written(described.groupBy("core").agg(F.sum("n").alias("times"), F.min("segment").alias("s0"), F.max("segment").alias("s1"))
                    .filter("times > 1").select("core", (F.col("s0") == F.col("s1")).alias("alike")), "cores")
    marked = written(described.join(cores, "core"), "repeated-spans")
    # Cores of one class: all their starts repeat.
    whole = marked.filter("alike").select("__k1", "__k2", "lo", (F.col("hi") + width).alias("hi"))
    mixed = marked.filter("not alike")
    classes = mixed.groupBy("core", "segment").agg(
        F.min(F.struct("__k1", "__k2", "lo", "hi", "off")).alias("at"), F.sum("n").alias("n"))
    crowds = classes.groupBy("core").agg(F.count("*").alias("classes"))
    shown = classes.join(crowds, "core").select("core", "segment", "n", "classes", "at.*")
    shown = written(_segments(shown, texts, width, step, piece), "segments")
    few = _sorted(shown.filter(F.col("classes") <= crowd).select("core", "segment", "bytes", "n"), width)
    many = _crowded(shown.filter(F.col("classes") > crowd).select("core", "segment", "n", "off", "bytes"), width, crowd)
    resolved = mixed.join(few.unionByName(many), ["core", "segment"]).select(
        "__k1", "__k2", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b") + width).alias("hi"))
    return texts, whole.unionByName(resolved)


def _segments(classes: DataFrame, texts: DataFrame, width: int, step: int, piece: int) -> DataFrame:
    """``classes`` with the bytes of their segments, read from pieces of the texts: no class copies a whole long text.

    Pieces overlap by what a segment reads beyond its first start. Their place is a range
    condition and no join key, so that the bucketed texts aren't shuffled again.
    """
    size = F.octet_length("text")
    cut = (texts.filter(size >= width).select("__k1", "__k2", F.col("text").cast("binary").alias("data"), F.explode(
        F.sequence(F.lit(0), F.floor((size - width) / piece).cast("int"))).alias("nth"))
        .select("__k1", "__k2", (F.col("nth") * F.lit(piece).cast("long")).alias("since"),
                F.substring("data", F.col("nth") * piece + 1, F.lit(piece + step + width)).alias("part")))
    inside = (F.col("lo") >= F.col("since")) & (F.col("lo") < F.col("since") + piece)
    both = classes.alias("c").join(cut.alias("p"), (F.col("c.__k1") == F.col("p.__k1")) & (F.col("c.__k2") == F.col("p.__k2")) & inside)
    return both.select("core", "segment", "n", "classes", "off", F.substring(
        F.col("part"), (F.col("lo") - F.col("since") + 1).cast("int"), (F.col("hi") - F.col("lo") + width).cast("int")).alias("bytes"))


def _sorted(classes: DataFrame, width: int) -> DataFrame:
    """(core, segment, a, b): the first and last repeated start of a class, from a suffix array of each core's classes
    (core, segment, bytes, n).

    A segment has at most ``width`` starts, so the strings of any two of them touch: all bytes between go too.
    """
    def sort(batches):
        held, size, core = [], 0, None

        def flush():
            found = repeats([h[2] for h in held], width)
            rows = []
            for (c, s, data, n), starts in zip(held, found):
                if n > 1:
                    rows.append((c, s, 0, len(data) - width))
                elif len(starts):
                    rows.append((c, s, int(starts[0]), int(starts[-1])))
            return pd.DataFrame(rows, columns=["core", "segment", "a", "b"])

        for pdf in batches:
            for c, s, data, n in zip(pdf["core"], pdf["segment"], pdf["bytes"], pdf["n"]):
                if c != core and size >= BATCH:
                    yield flush()
                    held, size = [], 0
                core = c
                held.append((c, s, data, n))
                size += len(data)
        if held:
            yield flush()

    return (classes.repartition("core").sortWithinPartitions("core", "segment")
            .select("core", "segment", "bytes", "n").mapInPandas(sort, "core long, segment long, a long, b long"))


def _crowded(shown: DataFrame, width: int, crowd: int, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(core, segment, a, b): the first and last repeated start of segments whose cores have very many classes.

    Spans are cut again and again, into parts of ever fewer starts at fixed places, with
    longer cores of their own. Equal parts are one class. Where a part's core has one class, all
    its starts repeat; up to ``crowd`` classes are sorted like any core's; the others are cut further. A part
    of one start is its own core.
    """
    rows = shown.select("core", "segment", "n", "off", F.lit(0).cast("long").alias("lead"), "bytes")
    found = None
    for fine in cuts:
        last = F.length("bytes") - width                               # of the row's starts
        begin = F.col("part") * fine - F.col("off")                    # of the part's possible starts
        parts = rows.select("*", F.explode(F.sequence(
            F.floor(F.col("off") / fine), F.floor((F.col("off") + last) / fine))).alias("part"))
        parts = parts.select("*", F.greatest(begin, F.lit(0)).cast("int").alias("a"), F.least(begin + fine - 1, last).cast("int").alias("b"),
                             F.xxhash64("core", "part", F.substring("bytes", (begin + fine).cast("int"), F.lit(width - fine + 1))).alias("inner"))
        parts = parts.select(
            "core", "segment", "n", "inner", (F.col("off") + F.col("a")).alias("off"), (F.col("lead") + F.col("a")).alias("lead"),
            F.substring("bytes", F.col("a") + 1, F.col("b") - F.col("a") + width).alias("bytes"))
        parts = written(parts.withColumn("own", F.xxhash64("off", "bytes")), "crowded-parts")
        classes = parts.groupBy("inner", "own").agg(F.sum("n").alias("n"), F.min("bytes").alias("bytes"))
        often = written(classes.groupBy("inner").agg(F.sum("n").alias("times"), F.count("*").alias("classes")).filter(
            "times > 1").select("inner", "classes"), "crowded-cores")
        marked = parts.join(often, "inner")
        whole = marked.filter("classes = 1").select("core", "segment", F.col("lead").alias("a"), (F.col("lead") + last).cast("long").alias("b"))
        some = classes.join(often.filter((F.col("classes") > 1) & (F.col("classes") <= crowd)), "inner")
        repeated = _sorted(some.select(F.col("inner").alias("core"), F.col("own").alias("segment"), "bytes", "n"), width)
        repeated = repeated.select(F.col("core").alias("inner"), F.col("segment").alias("own"), "a", "b")
        sorted_ = parts.select("core", "segment", "lead", "inner", "own").join(repeated, ["inner", "own"]).select(
            "core", "segment", (F.col("lead") + F.col("a")).alias("a"), (F.col("lead") + F.col("b")).alias("b"))
        here = whole.unionByName(sorted_)
        found = here if found is None else found.unionByName(here)
        rows = marked.filter(F.col("classes") > crowd).select("core", "segment", "n", "off", "lead", "bytes")
    return found.groupBy("core", "segment").agg(F.min("a").alias("a"), F.max("b").alias("b"))      # as in _sorted


def kept_bytes(text: str | None, ranges) -> tuple[bytes, int, int]:
    """What is left of a text's bytes, the number removed and the number of maximal removed runs."""
    data, out, at, removed, runs = (text or "").encode("utf-8"), [], 0, 0, 0
    end = -1
    for lo, hi in sorted(ranges):
        if lo > end:
            runs += 1
            out.append(data[at:lo])
            removed += hi - lo
        elif hi > end:
            removed += hi - end
        end = at = max(end, hi)
    out.append(data[at:])
    return b"".join(out), removed, runs


def deduplicate(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary).

    Each byte covered by a ``width``-byte string that also starts anywhere else goes;
    strings are judged on the input and never cross documents. A null text is empty;
    texts under ``width`` bytes keep all. Repeated rows repeat each other. Long texts are looked at in
    overlapping parts. A text of one sign throughout has an anchor, so a span, at every start; it takes a row a byte. Null ids are
    kept; other columns are ignored.
    """
    texts, ranges = removals(docs, width)
    lists = ranges.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))   # of one text

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut(text: pd.Series, ranges: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(text, ranges):
            kept, removed, runs = kept_bytes(t, [] if r is None else [(x["lo"], x["hi"]) for x in r])
            rows.append((len(kept) + removed, removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(lists, ["__k1", "__k2"], "left").select("__k1", "__k2", cut("text", "ranges").alias("x"))
    return docs.select("doc_id", *text_keys(F.col("text"))).join(done, ["__k1", "__k2"]).select("doc_id", "x.*")
