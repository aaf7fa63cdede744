"""Model preparation (M1-M12): flags, imputation, bucketing, one-hot, split, scaling, weights.

Everything is DataFrame expressions; the only driver-side values are scalars
(medians, means, standard deviations, class counts) and short level lists.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_weekend, weekday_monday0
from ..functions.exprs import flag, null_flag, safe_div
from ..operators.aggregates import value_counts
from ..operators.order_stats import ranked_values
from ..operators.selection import median_values, values_at_ranks
from ..session import materialize
from ..params import LOW_REVIEW_MAX, SEED, TEST_FRACTION, TOP_CATEGORIES

# Label, id, categorical and numeric columns of the two feature variants.
LABEL = "became_repeat_buyer"
ID_COLUMNS = ["customer_unique_id", "order_id", "order_purchase_timestamp", LABEL]
CATEGORICAL = ["customer_state", "product_category", "payment_type"]
NUMERIC = {
    "baseline": ["delivery_days", "days_early_vs_estimate", "order_value", "num_items",
                 "payment_installments", "review_score"],
    "improved": ["delivery_days", "days_early_vs_estimate", "order_value", "num_items",
                 "payment_installments", "review_score", "avg_item_value",
                 "purchase_month", "purchase_dow"],
}
MOST_LEVELS = 10_000     # one-hot columns in all


def add_flags(df: DataFrame, variant: str = "improved") -> DataFrame:
    """M1 missingness flags (before imputation); M2/M3 derived flags and numerics (improved)."""
    cols = {"order_never_delivered": null_flag("delivery_days"),
            "never_reviewed": null_flag("review_score")}
    if variant == "improved":
        ts = F.col("order_purchase_timestamp")
        cols.update({
            "delivered_late": flag(F.col("days_early_vs_estimate") < 0),
            "purchase_month": F.month(ts),
            "purchase_dow": weekday_monday0(ts),
            "is_weekend": is_weekend(ts),
            "avg_item_value": safe_div(F.col("order_value"), F.col("num_items")).cast("double"),
            "paid_in_installments": flag(F.col("payment_installments") > 1),
            "bad_first_review": flag(F.col("review_score") <= LOW_REVIEW_MAX),
        })
    return df.withColumns(cols)


def imputation_values(df: DataFrame, variant: str = "improved") -> dict:
    """Exact medians (pandas semantics) over all rows before the drop (M4)."""
    med_cols = ["delivery_days", "review_score"] + (["avg_item_value"] if variant == "improved" else [])
    return median_values(df, med_cols)


def impute(df: DataFrame, medians: dict) -> DataFrame:
    """M4: medians, 0 for days_early_vs_estimate, 'unknown' for the categoricals."""
    fills = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in medians.items()
             if v is not None}
    fills["days_early_vs_estimate"] = F.coalesce(F.col("days_early_vs_estimate"), F.lit(0.0))
    fills["product_category"] = F.coalesce(F.col("product_category"), F.lit("unknown"))
    fills["payment_type"] = F.coalesce(F.col("payment_type"), F.lit("unknown"))
    return df.withColumns(fills)


def drop_incomplete(df: DataFrame) -> DataFrame:
    """M5: drop rows lacking order value, item count or installments."""
    return df.dropna(subset=["order_value", "num_items", "payment_installments"])


def bucket_top_categories(df: DataFrame, col: str = "product_category",
                          n: int = TOP_CATEGORIES, other: str = "other") -> DataFrame:
    """M6: keep the n most frequent values (count desc, value asc), the rest -> ``other``.

    The n values of the list reach the driver and become literals, so that frames built on the result don't count again.
    """
    top = [r[0] for r in value_counts(df, col, top=n).collect()]
    kept = F.col(col).isin([v for v in top if v is not None])
    if None in top:
        kept = kept | F.col(col).isNull()
    return df.withColumn(col, F.when(kept, F.col(col)).otherwise(F.lit(other)))


def category_levels(df: DataFrame, cols=CATEGORICAL, most: int = MOST_LEVELS) -> dict[str, list]:
    """Sorted distinct levels per categorical column; NULL is no level.

    The encoded frame has a column per level. More than ``most`` levels in all are an
    error: such columns are to be bucketed first.
    """
    pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("l")) for c in cols]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").filter("l is not null").distinct()
    out: dict[str, list] = {c: [] for c in cols}
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"over {most} levels in {', '.join(cols)}: bucket them first")
    for r in found:
        out[r["c"]].append(r["l"])
    return {c: sorted(levels) for c, levels in out.items()}


def one_hot(df: DataFrame, levels: dict[str, list], drop_first: bool = True) -> DataFrame:
    """M7: get_dummies(drop_first=True): 0/1 column ``{col}_{level}`` per level but the first.
    A NULL value is 0 in all of them."""
    new = {}
    for c, lv in levels.items():
        for level in (lv[1:] if drop_first else lv):
            new[f"{c}_{level}"] = F.coalesce(F.col(c) == F.lit(level), F.lit(False)).cast("int")
    return df.withColumns(new).drop(*levels.keys())


def feature_columns(df: DataFrame) -> list[str]:
    """M8: every column but ids, timestamp and label."""
    return [c for c in df.columns if c not in ID_COLUMNS]


def lehmer_key(col: str, seed: int = SEED) -> F.Column:
    """Deterministic pseudo-random key in [0, 2^31 - 1) from an integer id (two LCG steps).

    Plain integer arithmetic, so any SQL engine can reproduce it.
    """
    p = 2147483647
    x = (F.pmod(F.col(col), F.lit(p)) * 48271 + F.lit(seed)) % p
    return (x * 48271) % p


def hash_key(col: str, seed: int = SEED) -> F.Column:
    """Default split key for ids of any type: 63-bit xxhash64 of (id, seed)."""
    return F.xxhash64(F.col(col), F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))


def share_of_test(counts: dict, test_fraction: float = TEST_FRACTION) -> dict:
    """Test rows per class: in all ceil(f * n); the n - ceil(f * n) training rows are shared out
    over the classes in proportion, the rest by largest remainder (ties: smaller class first)."""
    n = sum(counts.values())
    frac = Fraction(test_fraction).limit_denominator(10**6)
    train = n - -(-n * frac.numerator // frac.denominator)
    exact = {c: Fraction(nc * train, n) for c, nc in counts.items()}
    share = {c: int(x) for c, x in exact.items()}
    for c in sorted(counts, key=lambda c: (share[c] - exact[c], c))[:train - sum(share.values())]:
        share[c] += 1
    return {c: nc - share[c] for c, nc in counts.items()}


def stratified_split(df: DataFrame, label: str = LABEL, id_col: str = "customer_unique_id",
                     test_fraction: float = TEST_FRACTION, seed: int = SEED,
                     key: F.Column | None = None) -> DataFrame:
    """M9: add ``is_test``: per class the rows with the smallest (key, id), as many as ``share_of_test``.

    The cut per class is an exact k-th statistic of the key (a number) by narrowing histograms over (label, key, id), written once;
    the frame itself only gets a filter expression. Rows tied with the cut on the key go in
    id order, by a second cut on the id. Rows of equal id and key fall on one side;
    rows without a key are training rows. The classes
    of a label are few (their counts reach the driver).
    """
    key = key if key is not None else hash_key(id_col, seed)
    k = materialize(df.select(F.col(label).alias("_g"), key.alias("_key"), F.col(id_col).alias("_id")))
    counts = {r["_g"]: r["n"] for r in k.groupBy("_g").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = {c: n for c, n in share_of_test(counts, test_fraction).items() if n > 0}

    def last(of, wanted):
        """Per class the row of ``of`` that holds the last of ``wanted`` rows."""
        hit = F.lit(False)
        for c, n in wanted.items():
            hit = hit | (F.col("_g").eqNullSafe(F.lit(c)) & (F.col("below") < n) & (F.col("below") + F.col("n") >= n))
        return {r["_g"]: r for r in of.filter(hit).collect()}

    at = values_at_ranks(k, lambda c, _: [need[c] - 1] if c in need else [], "_key")
    cuts = {c: {"_key": v, "below": below, "n": n} for (c, _), (v, below, n) in at.items()}
    # the usual case is a unique cut key; else only the rows tied with it are ranked by id
    tied = {c: need[c] - r["below"] for c, r in cuts.items() if r["below"] + r["n"] > need[c]}
    at_cut = F.lit(False)
    for c in tied:
        at_cut = at_cut | (F.col("_g").eqNullSafe(F.lit(c)) & (F.col("_key") == cuts[c]["_key"]))
    ids = last(ranked_values(k.filter(at_cut), "_id", ("_g",)), tied) if tied else {}
    cond = F.lit(False)
    for c, r in cuts.items():
        upto = key <= F.lit(r["_key"])
        if c in tied:
            upto = (key < F.lit(r["_key"])) | ((key == F.lit(r["_key"])) & (F.col(id_col) <= F.lit(ids[c]["_id"])))
        cond = cond | (F.col(label).eqNullSafe(F.lit(c)) & upto)
    return df.withColumn("is_test", F.coalesce(cond, F.lit(False)))


def standardize(df: DataFrame, cols: list[str], fit_on: DataFrame) -> DataFrame:
    """(x - mean) / population std, statistics fitted on ``fit_on`` (the train split)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    st = fit_on.agg(*aggs).first()
    out = {}
    for c in cols:
        m, s = st[f"m_{c}"], st[f"s_{c}"]
        out[c] = (F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
    return df.withColumns(out)


def class_counts(df: DataFrame, label: str = LABEL) -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


def balanced_weight(df: DataFrame, counts: dict, label: str = LABEL) -> DataFrame:
    """class_weight='balanced' → n / (2 n_c)."""
    n = sum(counts.values())
    w = F.lit(None).cast("double")
    for c, nc in counts.items():
        w = F.when(F.col(label) == c, F.lit(n / (len(counts) * nc))).otherwise(w)
    return df.withColumn("weight", w)


def positive_weight(df: DataFrame, counts: dict, label: str = LABEL) -> DataFrame:
    """scale_pos_weight = neg / pos on positives, 1 on negatives."""
    spw = counts.get(0, 0) / counts[1] if counts.get(1) else 1.0
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(spw)).otherwise(F.lit(1.0)))


def prepare(features: DataFrame, variant: str = "improved") -> tuple[DataFrame, dict]:
    """Flags → impute (medians over all rows) → drop → top-15 → one-hot.

    Returns the encoded frame and the fitted values (medians, levels) so that
    new data can be encoded identically.
    """
    f = materialize(add_flags(features, variant))
    med = imputation_values(f, variant)
    f = bucket_top_categories(drop_incomplete(impute(f, med)))
    levels = category_levels(f)
    return one_hot(f, levels), {"medians": med, "levels": levels}


def class_weight_table(df: DataFrame, label: str = LABEL) -> DataFrame:
    """M11/M12 as a table: per class its count, the balanced weight n / (2 n_c) and the
    positive-class weight neg / pos (1 for negatives). One aggregation, no driver values."""
    from pyspark.sql import Window
    c = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_class"))
    everything = Window.partitionBy()  # over the per-class table: one row per class
    n = F.sum("n_class").over(everything)
    k = F.count(F.lit(1)).over(everything)
    neg = F.sum(F.when(F.col("label") == 0, F.col("n_class"))).over(everything)
    return c.select("label", "n_class",
                    (n / (k * F.col("n_class"))).alias("balanced_weight"),
                    F.when(F.col("label") == 1, neg / F.col("n_class")).otherwise(F.lit(1.0))
                     .alias("positive_weight"))
