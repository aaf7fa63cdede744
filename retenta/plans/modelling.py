"""End-to-end modelling plans: the model-ready frame, split, models, reports."""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ml import metrics, models, prep, stages
from ..session import materialize, scratch_path
from ..sources import sinks
from ..sources.tables import Tables
from .features import first_order_features


def model_frame(t: Tables, variant: str = "improved") -> DataFrame:
    """The encoded, imputed frame (wide, one 0/1 column per kept level)."""
    enc, _ = prep.prepare(first_order_features(t), variant)
    return enc


def model_frame_long(t: Tables, variant: str = "improved") -> DataFrame:
    """X3 in long form (customer_unique_id, feature, value): column-set independent, SQL-checkable.
    Zeros are left out, as in a sparse vector."""
    enc = model_frame(t, variant)
    feats = prep.feature_columns(enc)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col("`" + c.replace("`", "``") + "`").cast("double").alias("value"))
             for c in feats]
    long = enc.select("customer_unique_id", F.inline(F.array(*pairs)))
    return long.filter("value <> 0 or value is null")


def train_fitted_long(t: Tables, variant: str = "improved", digits: int = 6) -> DataFrame:
    """X3 with medians, category list, levels and scales of the training rows alone, in long form: the cells that
    aren't 0 (customer_unique_id, is_test, feature, value), and for each column, under the id -1, the number of its zeros."""
    _, enc = stages.fitted(first_order_features(t), variant, fit_on="train", key=prep.lehmer_key("customer_unique_id"))
    enc = materialize(enc)
    names = prep.feature_columns(enc.drop("is_test"))
    value = {c: F.round(F.col("`" + c.replace("`", "``") + "`").cast("double"), digits) for c in names}
    cells = enc.select("customer_unique_id", F.col("is_test").cast("int").alias("is_test"),
                       F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), v.alias("value")) for c, v in value.items()])))
    zeros = enc.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.count_if(v == 0).cast("double").alias("value"))
                              for c, v in value.items()]).alias("z"))
    zeros = zeros.select(F.lit(-1).cast("long").alias("customer_unique_id"), F.lit(None).cast("int").alias("is_test"), F.inline("z"))
    return cells.filter("value <> 0 or value is null").unionByName(zeros)


def split_assignment(t: Tables, key: str = "lehmer") -> DataFrame:
    """M9: (customer_unique_id, label, is_test) on the model-ready rows."""
    enc = model_frame(t)
    k = prep.lehmer_key("customer_unique_id") if key == "lehmer" else None
    s = prep.stratified_split(enc, key=k)
    return s.select("customer_unique_id", F.col(prep.LABEL).alias("label"),
                    F.col("is_test").cast("int").alias("is_test"))


def standardized_frame(t: Tables, variant: str = "improved", key=None) -> DataFrame:
    """The model frame with numeric columns scaled by train-split mean and population std
    (fitted on train only, applied to both splits); ``is_test`` marks the split."""
    enc = model_frame(t, variant)
    s = prep.stratified_split(enc, key=key)
    train = s.filter(~F.col("is_test"))
    return prep.standardize(s, prep.NUMERIC[variant], fit_on=train)


def standardized_long(t: Tables, variant: str = "improved", digits: int = 6) -> DataFrame:
    """M10 in long form (customer_unique_id, is_test, feature, value), split by the integer key,
    rounded so that two engines' sums of doubles agree."""
    s = standardized_frame(t, variant, key=prep.lehmer_key("customer_unique_id"))
    cells = [F.struct(F.lit(c).alias("feature"), F.round(F.col(c), digits).alias("value")) for c in prep.NUMERIC[variant]]
    return s.select("customer_unique_id", F.col("is_test").cast("int").alias("is_test"), F.inline(F.array(*cells)))


def heuristic_scored(t: Tables) -> DataFrame:
    """A deterministic score on the whole feature table for exercising the metric operators:
    score = first-order value, prediction = 1 when the first order has at least 4 items."""
    f = first_order_features(t)
    return f.filter(F.col("order_value").isNotNull()).select(
        "customer_unique_id", F.col(prep.LABEL).alias("label"),
        F.col("order_value").alias("score"),
        (F.col("num_items") >= 4).cast("int").alias("prediction"))


# Prepared splits and fitted models, kept with the table bundle that they were built from: several
# reports read the same fitted model (T3 and X4 share the boosted trees, T2 and T6 the forest).
_CACHE: "weakref.WeakKeyDictionary[Tables, dict]" = weakref.WeakKeyDictionary()


def _cached(t: Tables, key, build):
    held = _CACHE.setdefault(t, {})
    if key not in held:
        held[key] = build()
    return held[key]


def _prepared(t: Tables, variant: str) -> models.Prepared:
    return _cached(t, ("prepared", variant),
                   lambda: models.prepare_splits(first_order_features(t), variant,
                                                 key=prep.lehmer_key("customer_unique_id")))


def _fit(t: Tables, kind: str, variant: str, **kw):
    runners = {"logistic": models.run_logistic, "forest": models.run_forest,
               "boosted": models.run_boosted}
    return _cached(t, (kind, variant, repr(sorted(kw.items()))),
                   lambda: runners[kind](_prepared(t, variant), **kw))


def logistic_eval(t: Tables, variant: str = "baseline") -> DataFrame:
    _, scored = _fit(t, "logistic", variant)
    return models.evaluate(scored, f"logistic_regression_{variant}")


# Two columns whose Newton steps SQL can solve in closed form.
NEWTON_PAIR = ["order_value", "review_score"]


def newton_coefficients(t: Tables, digits: int = 6) -> DataFrame:
    """T1 on two standardised columns of the training rows: (feature, coefficient), the intercept included."""
    model, _ = _fit(t, "logistic", "baseline", features=NEWTON_PAIR)
    values = [*zip(NEWTON_PAIR, model.held("coefficients")), ("(intercept)", model.held("intercept"))]
    df = t.orders.sparkSession.createDataFrame(values, "feature string, coefficient double")
    return df.select("feature", F.round("coefficient", digits).alias("coefficient"))


def newton_scores(t: Tables, digits: int = 6) -> DataFrame:
    """E1 of the same model: every test row's label, P(repeat) and class."""
    _, scored = _fit(t, "logistic", "baseline", features=NEWTON_PAIR)
    return scored.select("customer_unique_id", "label", F.round("score", digits).alias("score"), "prediction")


def published_gaps(t: Tables, top: int = 12) -> DataFrame:
    """T6, L6, S13 on a measure that SQL can state: how far the classes' means of each numeric column lie apart, in standard
    deviations to one decimal (so that some are equal), ranked, written as CSV and read back."""
    f = model_frame(t)
    names = [c for c in prep.feature_columns(f) if not c.startswith(tuple(f"{k}_" for k in prep.CATEGORICAL))]
    mean = lambda c, y: F.avg(F.when(F.col(prep.LABEL) == y, F.col(c).cast("double")))
    gap = {c: F.round(F.try_divide(F.abs(mean(c, 1) - mean(c, 0)), F.stddev_pop(F.col(c).cast("double"))), 1) for c in names}
    gaps = f.agg(F.array(*[F.struct(F.lit(c).alias("feature"), g.alias("importance")) for c, g in gap.items()]).alias("g")).select(F.inline("g"))
    path = scratch_path(f.sparkSession, "importances")
    sinks.write_importances(models.ranked(gaps, top), path)
    back = f.sparkSession.read.schema("feature string, importance double").option("header", True).csv(path)
    return back.select((F.monotonically_increasing_id() + 1).alias("place"), "feature", "importance")    # one file: its lines' order


def forest_eval(t: Tables, **kw) -> DataFrame:
    _, scored = _fit(t, "forest", "baseline", **kw)
    return models.evaluate(scored, "random_forest_baseline")


def boosted_eval(t: Tables, max_iter: int = 400) -> DataFrame:
    _, scored = _fit(t, "boosted", "improved", max_iter=max_iter)
    return models.evaluate(scored, "boosted_trees_improved")


def forest_importances(t: Tables, top: int = 15) -> DataFrame:
    model, _ = _fit(t, "forest", "baseline")
    return models.importances(t.orders.sparkSession, model, _prepared(t, "baseline").feature_cols, top)


def evaluation_report(t: Tables, gbt_iter: int = 400) -> dict[str, DataFrame]:
    """X4 for the improved features: LR and boosted trees, metrics, best-model choice (T5),
    threshold scenarios (T4), the decision matrix (D7) and importances (T6)."""
    p = _prepared(t, "improved")
    _, lr_scored = _fit(t, "logistic", "improved")
    gbt, gbt_scored = _fit(t, "boosted", "improved", max_iter=gbt_iter)
    rep = models.evaluate(lr_scored, "logistic_regression").unionByName(
        models.evaluate(gbt_scored, "boosted_trees"))
    aucs = {r["model"]: r["roc_auc"] for r in rep.collect()}
    best = models.best_model(aucs)
    scored = gbt_scored if best == "boosted_trees" else lr_scored
    scen = metrics.threshold_scenarios(scored)
    return {
        "metrics": rep.withColumn("selected", F.col("model") == F.lit(best)),
        "scenarios": scen,
        "decision_matrix": metrics.decision_matrix(scen),
        "importances": models.importances(t.orders.sparkSession, gbt, p.feature_cols),
        "confusion_matrix": metrics.confusion_matrix(scored),
        "classification_report": metrics.classification_report(scored),
    }


def baseline_report(t: Tables, **forest) -> dict[str, DataFrame]:
    """X4 for the baseline features: logistic regression and random forest on the baseline
    frame, each with metrics, confusion matrix and per-class report, and the forest's importances."""
    p = _prepared(t, "baseline")
    _, lr_scored = _fit(t, "logistic", "baseline")
    model, rf_scored = _fit(t, "forest", "baseline", **forest)
    scored = {"logistic_regression": lr_scored, "random_forest": rf_scored}
    evaluated = [models.evaluate(s, name) for name, s in scored.items()]
    out = {"metrics": evaluated[0].unionByName(evaluated[1]),
           "importances": models.importances(t.orders.sparkSession, model, p.feature_cols)}
    for name, s in scored.items():
        out[f"confusion_matrix_{name}"] = metrics.confusion_matrix(s)
        out[f"classification_report_{name}"] = metrics.classification_report(s)
    return out
