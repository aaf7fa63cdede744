"""Exact top-k inner products over norm-sorted vectors.

Vectors are rotated by the right singular vectors of the whole table, so that
the first coordinates carry most of every product, and dealt to blocks by
descending length. A block of queries skips a block of candidates whose
greatest length can't reach the queries' thresholds (Cauchy-Schwarz); within a
block, the product of the first coordinates plus the product of the residual
lengths bounds each score, and only pairs whose bound reaches the threshold get
their exact integer product. The longest vectors are scanned first and give the thresholds.

Queries meet candidates cell by cell: a cell is a few blocks of queries and a few blocks of candidates, of bounded size, and
the blocks of a cell are sent to one task once. Neither side is ever whole in one task, and neither is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

BLOCK = 1024        # vectors in a block of candidates
QUERIES = 256       # vectors in a block of queries
CELL = (8, 16)      # blocks of candidates and of queries in a cell
LEADING = 24        # coordinates in the partial sums
EXACT = 2.0 ** 52   # products below this are exact in doubles


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (array<double>) of the rows with neither null nor non-finite components; v is floor(256 x)."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    good = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return (vectors.filter(F.col("embedding").isNotNull() & good & F.col("vec_id").isNotNull())
            .select(F.col("vec_id").cast("long").alias("id"), F.transform(x, lambda e: F.floor(e * 256).cast("double")).alias("v")))


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, :len(v)] = v
    return out


def _basis(rows: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, from the sum of their outer products (width x width)."""
    def gram(batches):
        total = np.zeros((width, width))
        for pdf in batches:
            m = _matrix(pdf["v"], width)
            m /= max(1.0, np.abs(m).max(initial=0.0))     # only a direction is wanted: no overflow
            total += m.T @ m
        yield pd.DataFrame({"i": range(width), "row": list(total)})

    got = (rows.select("v").mapInPandas(gram, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x"))
           .groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas())      # width x width numbers
    g = np.zeros((width, width))
    g[got["i"], got["j"]] = got["x"]
    return np.linalg.eigh(g)[1][:, ::-1].copy()


def top_k(vectors: DataFrame, k: int = 5, query_step: int = 50, block: int = BLOCK, queries: int = QUERIES,
          leading: int = LEADING) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` highest integer inner products, ties to smaller vec_id.

    ``vectors`` has vec_id and embedding. Queries: rows whose vec_id is divisible by
    ``query_step``; candidates: every row but the query's own. Rows that repeat a vec_id, or a whole row, count one by
    one: each is a query with ranks of its own, and a candidate of the others. Vectors null, or with null or non-finite components, take no part, nor do
    null ids; shorter vectors count as padded with zeros; scores beyond a long are cut to its range.
    Other columns are ignored. Empty input, empty result.
    """
    spark = vectors.sparkSession
    # Written once, so that a row keeps its number whatever is computed again.
    rows = written(usable(vectors).select("*", F.monotonically_increasing_id().alias("row"), F.sqrt(
        F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm")), "vectors")
    width, count = rows.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 1
    shared = spark.sparkContext.broadcast(_basis(rows, width))               # width x width numbers
    schema = "cg long, top double, rows binary, ids binary, vs binary"

    def pack(size):
        def run(batches):
            n, first = 0, TaskContext.get().partitionId() << 32
            for pdf in batches:
                for i in range(0, len(pdf), size):
                    part = pdf.iloc[i:i + size]
                    yield pd.DataFrame({"cg": [first + n // CELL[0]], "top": [float(part["norm"].max())],
                                        "rows": [part["row"].to_numpy(np.int64).tobytes()],
                                        "ids": [part["id"].to_numpy(np.int64).tobytes()],
                                        "vs": [_matrix(part["v"], width).tobytes()]})
                    n += 1
        return run

    # Descending length; ids and row numbers part the ties, so that equal vectors spread over blocks.
    parts = min(shuffle_partitions(spark), max(12, -(-count // (CELL[0] * block))))
    ordered = rows.repartitionByRange(parts, F.desc("norm"), "id", "row").sortWithinPartitions(F.desc("norm"), "id", "row")
    candidates = written(ordered.mapInPandas(pack(block), schema), "candidate-blocks")
    asked = rows.filter(F.col("id") % query_step == 0)
    # The lead, one block of the longest vectors, gives every query its first threshold.
    first = candidates.orderBy(F.desc("top"), "cg").limit(1).select("rows", "ids", "vs").first()
    if first is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    lead = spark.sparkContext.broadcast(tuple(first))                        # one block
    blind = _ask(asked.withColumn("floor", F.lit(float("-inf"))), queries, width)
    scores = blind.select("qrows", "qids", "qvs", "floors").mapInPandas(_lead(shared, width, k, leading, lead), SCORES)
    floors = scores.filter(F.col("nth") == k).select("query_row", F.col("score").cast("double").alias("f"))
    known = asked.join(floors, asked["row"] == floors["query_row"], "left").select(
        "row", "id", "v", "norm", F.coalesce("f", F.lit(float("-inf"))).alias("floor"))
    blocks = written(_ask(known, queries, width), "query-blocks")
    # Every group of query blocks meets every group of candidate blocks that is long enough for it.
    cells = blocks.groupBy("qg").agg(F.min("need").alias("need")).crossJoin(candidates.groupBy("cg").agg(F.max("top").alias("top")))
    cells = written(cells.filter(F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("need")).select("qg", "cg"), "cells")
    # Files of like vectors are small and their rows are not, so file sizes mustn't choose a broadcast.
    asks = blocks.hint("merge").join(cells, "qg").select("qg", "cg", "qrows", "qids", "qvs", "floors").groupBy("qg", "cg")
    held = candidates.hint("merge").join(cells, "cg").select("qg", "cg", "top", "rows", "ids", "vs").groupBy("qg", "cg")
    found = asks.cogroup(held).applyInPandas(_cell(shared, width, k, leading), SCORES)
    # Under each window only the k best of a task are shuffled.
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SCORES = "query_row long, query_id long, vec_id long, score long, nth long"


def _ask(asked: DataFrame, size: int, width: int) -> DataFrame:
    """Query blocks, of like ratio of floor to length, so that whole blocks can be skipped."""
    def run(batches):
        n, first = 0, TaskContext.get().partitionId() << 32
        for pdf in batches:
            for i in range(0, len(pdf), size):
                p = pdf.iloc[i:i + size]
                yield pd.DataFrame({"qg": [first + n // CELL[1]], "need": [float(p["need"].min())],
                                    "qrows": [p["row"].to_numpy(np.int64).tobytes()],
                                    "qids": [p["id"].to_numpy(np.int64).tobytes()],
                                    "qvs": [_matrix(p["v"], width).tobytes()], "floors": [p["floor"].to_numpy(float).tobytes()]})
                n += 1

    need = F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(float("-inf")))
    ordered = asked.withColumn("need", need).repartitionByRange("need", "row").sortWithinPartitions("need", "row")
    return ordered.select("row", "id", "v", "floor", "need").mapInPandas(
        run, "qg long, need double, qrows binary, qids binary, qvs binary, floors binary")


def _lead(shared, width: int, k: int, leading: int, lead):
    """Query blocks to the ``k`` best of each query in the ``lead`` block."""
    def run(batches):
        basis = shared.value
        block = _candidates(*lead.value, basis, width, leading)
        for pdf in batches:
            for ask in zip(pdf["qrows"], pdf["qids"], pdf["qvs"], pdf["floors"]):
                yield _best(*ask, [block], basis, width, k, leading)

    return run


def _cell(shared, width: int, k: int, leading: int):
    """The query blocks and candidate blocks of a cell to the ``k`` best of each query there."""
    def run(asks, held):
        basis = shared.value
        blocks = [_candidates(*c, basis, width, leading) for c in zip(*(held.sort_values("top", ascending=False)[n] for n in ("rows", "ids", "vs")))]
        found = [_best(*ask, blocks, basis, width, k, leading) for ask in zip(asks["qrows"], asks["qids"], asks["qvs"], asks["floors"])]
        return pd.concat(found, ignore_index=True) if found else _scores()

    return run


def _scores(query_row=(), query_id=(), vec_id=(), score=(), nth=()) -> pd.DataFrame:
    return pd.DataFrame({name: np.asarray(x, np.int64) for name, x in zip(("query_row", "query_id", "vec_id", "score", "nth"),
                                                                          (query_row, query_id, vec_id, score, nth))})


def _candidates(rows, ids, vs, basis: np.ndarray, width: int, leading: int) -> tuple:
    """A block's row numbers, ids, vectors, leading rotated coordinates, lengths of the others, and lengths."""
    c = np.frombuffer(vs).reshape(-1, width)
    with np.errstate(over="ignore", invalid="ignore"):
        r = c @ basis
        m = min(leading, width)
        return (np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), c, np.ascontiguousarray(r[:, :m].T),
                np.linalg.norm(r[:, m:], axis=1), np.linalg.norm(c, axis=1))


def _best(qrows, qids, qvs, floors, blocks: list[tuple], basis: np.ndarray, width: int, k: int, leading: int) -> pd.DataFrame:
    """The ``k`` best of each query of a block among the candidates of ``blocks``; what can't reach a query's floor may be left out.

    Floors rise as blocks are scanned: ``k`` scores found are a floor for the next block.
    """
    qrow, qid, floor = np.frombuffer(qrows, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(floors).copy()
    q = np.frombuffer(qvs).reshape(-1, width)
    at, vec, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    nth = at
    with np.errstate(over="ignore", invalid="ignore"):
        r = q @ basis
        m = min(leading, width)
        lead, rest, length = r[:, :m], np.linalg.norm(r[:, m:], axis=1), np.linalg.norm(q, axis=1)
        for row, cid, c, clead, crest, clength in blocks:
            # A bound that isn't a number can't prune.
            i = np.flatnonzero(~(length * clength.max(initial=0.0) * (1 + 1e-9) + 1e-6 < floor))
            if not len(i):
                continue
            bound = lead[i] @ clead
            bound += rest[i, None] * crest
            bound += (1e-9 * length[i, None]) * clength + 1e-6
            alive = ~(bound < floor[i, None])
            alive &= qrow[i, None] != row
            if np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0) * width < EXACT:
                some, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
                i, alive = i[some], alive[np.ix_(some, cols)]
                product = q[i] @ c[cols].T                        # whole numbers below 2^52: exact
                x, y = np.nonzero(alive & (product >= floor[i, None]))
                new, x, y = product[x, y].astype(np.int64), i[x], cols[y]
            else:
                x, y = np.nonzero(alive)
                x = i[x]
                exact = [sum(int(a) * int(b) for a, b in zip(c[v], q[u])) for u, v in zip(x, y)]
                new = np.array([min(max(e, -2 ** 63), 2 ** 63 - 1) for e in exact], np.int64)
            if not len(x):
                continue
            at, vec, score = np.concatenate([at, x]), np.concatenate([vec, cid[y]]), np.concatenate([score, new])
            order = np.lexsort((vec, ~score, at))                 # ~score falls as score grows, without overflow
            at, vec, score = at[order], vec[order], score[order]
            nth = np.arange(len(at)) - np.searchsorted(at, at) + 1
            at, vec, score, nth = (a[nth <= k] for a in (at, vec, score, nth))
            full = nth == k
            floor[at[full]] = np.fmax(floor[at[full]], score[full].astype(float))
    return _scores(qrow[at], qid[at], vec, score, nth)
