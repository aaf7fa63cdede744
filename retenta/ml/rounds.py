"""Boosted trees judged after every round by PR-AUC (T3), and cut where it is highest.

Spark's boosting is stopped by its loss only. Here a fitted model's trees are read once as a
table (round, leaf, what the leaf adds to the margin); each row's leaves give what every round added,
running sums of that are its margins after 1, 2, ... rounds, and the curves of all rounds are
one grouped prefix sum.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prefix import cumulative_sums
from ..session import materialize
from .metrics import AP_SCALE
from .prep import LABEL


def leaf_table(spark, model: GBTClassificationModel) -> DataFrame:
    """(round from 1, leaf, gain): trees x 2^depth rows at most, a bound set by the model's parameters."""
    rows = []
    for i, (tree, weight) in enumerate(zip(model.trees, model.treeWeights), 1):
        stack, leaf = [tree._java_obj.rootNode()], 0
        while stack:                                        # leaves are numbered from left to right
            node = stack.pop()
            if node.subtreeDepth() == 0:
                rows.append((i, leaf, float(weight) * node.prediction()))
                leaf += 1
            else:
                stack += [node.rightChild(), node.leftChild()]
    return spark.createDataFrame(rows, "round int, leaf int, gain double")


def staged_scores(model: GBTClassificationModel, assembled: DataFrame, label: str = LABEL) -> DataFrame:
    """(round, label, score): every row's P(1) after each round. ``assembled`` has the features vector and the label."""
    leaves = model.copy().setLeafCol("__leaf").transform(assembled.select("features", F.col(label).alias("label")))
    rows = materialize(leaves.select("label", F.monotonically_increasing_id().alias("row"), vector_to_array("__leaf").alias("leaf")))
    each = rows.select("row", "label", F.posexplode("leaf").alias("r", "leaf")).select(
        "row", "label", (F.col("r") + 1).alias("round"), F.col("leaf").cast("int").alias("leaf"))
    gains = each.join(F.broadcast(leaf_table(assembled.sparkSession, model)), ["round", "leaf"])
    so_far = Window.partitionBy("row").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)     # a row's rounds: as many as trees
    margin = F.sum("gain").over(so_far)
    return gains.select("round", "label", (F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * margin))).alias("score"))


def average_precision_by_round(model: GBTClassificationModel, assembled: DataFrame, label: str = LABEL) -> DataFrame:
    """(round, average_precision): E3 of the model after each round; null where no row is positive."""
    counts = staged_scores(model, assembled, label).groupBy("round", "score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    curve = cumulative_sums(counts, "score", ["pos", "neg"], descending=True, groups=("round",))
    big = "decimal(38,0)"
    a = F.col("pos").cast(big) * F.col("cum_pos").cast(big) * F.lit(AP_SCALE).cast(big)
    b = (F.col("cum_pos") + F.col("cum_neg")).cast(big)
    return curve.groupBy("round").agg(
        F.sum(((a - a % b) / b).cast(big)).cast("double").alias("s"), F.sum("pos").alias("p")).select(
        "round", F.when(F.col("p") > 0, F.col("s") / (F.col("p").cast("double") * float(AP_SCALE))).alias("average_precision"))


def best_round(by_round: DataFrame) -> tuple[int, float]:
    """The round of highest average precision, the earliest of equals."""
    r = by_round.filter("average_precision is not null").orderBy(F.col("average_precision").desc(), "round").first()
    if r is None:
        raise ValueError("no round has an average precision: no positive row")
    return r["round"], r["average_precision"]


def cut_after(model: GBTClassificationModel, rounds: int, assembled: DataFrame, label: str = LABEL) -> DataFrame:
    """E1 of the model as it was after ``rounds`` rounds: customer_unique_id, label, score, prediction."""
    table = leaf_table(assembled.sparkSession, model).filter(F.col("round") <= rounds)
    by_round = table.groupBy("round").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("leaf", "gain"))), lambda x: x["gain"]).alias("leaves"))
    gains = by_round.agg(F.array_sort(F.collect_list(F.struct("round", "leaves"))).alias("gains"))      # one row, as large as the model
    leaves = model.copy().setLeafCol("__leaf").transform(assembled)
    both = leaves.withColumn("__leaf", F.slice(vector_to_array("__leaf"), 1, rounds)).crossJoin(F.broadcast(gains))
    margin = F.aggregate(F.zip_with("gains", "__leaf", lambda g, leaf: g["leaves"][leaf.cast("int")]), F.lit(0.0), lambda s, v: s + v)
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-2.0 * margin))
    return both.select("customer_unique_id", F.col(label).alias("label"), score.alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int"))
