"""Threshold tuning and evaluation over a scored, labelled frame.

A frame has ``row_id``, ``anomaly_score`` (six decimals), ``is_anomaly`` (the
true label), ``anomaly_type`` and the key columns. Sweeps count every
threshold in one scan with map-side partial counts; rows are never multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CalibrationConfig, FP_CURVE_GRID, KEYS, SENSITIVITY_GRID, SIGNAL_COLUMNS, TunerConfig
from ..functions.exprs import join_on
from ..functions.quantiles import score_quantiles


def zscore_score(df: DataFrame, target: str = "total_cost", by: str = "account_id", cap: float = 5.0,
                 out: str = "anomaly_score") -> DataFrame:
    """Per-account absolute z-score, scaled by ``cap`` to [0, 1].

    Mean and deviation come from a partial aggregate joined back, not from a
    window, so an account with a third of all rows is not one task. The join
    side is one row per account; AQE picks broadcast or skew-split by its size.
    """
    x = F.col(target).cast("double")
    stats = df.groupBy(by).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    sd = F.when(F.col("_sd") > F.abs("_mu") * F.lit(1e-12), F.col("_sd")).otherwise(F.lit(1.0))
    z = F.abs(x - F.col("_mu")) / sd
    score = F.round(F.least(z / F.lit(cap), F.lit(1.0)), 6)
    return join_on(df, stats, [by]).withColumn(out, score).drop("_mu", "_sd")


def ratio(num: Column, den: Column, undefined: float | None = 0.0) -> Column:
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(undefined).cast("double"))


def resolve_labels(df: DataFrame, external: DataFrame | None = None, row_id: str = "row_id",
                   label: str = "is_anomaly", out: str = "label") -> DataFrame:
    """``label`` from an external table by row id if it has any matching row,
    else from the frame's own column, else NULL (unsupervised)."""
    own = F.col(label).cast("int") if label in df.columns else F.lit(None).cast("int")
    if external is None:
        return df.withColumn(out, own)
    # whether any row found an external label is decided once, as a single row
    # an id given more than once is an anomaly if any of its labels says so
    ext = external.groupBy(row_id).agg(F.max(F.col("label").cast("int")).alias("_ext"))
    joined = df.join(ext, row_id, "left")
    any_ext = joined.agg((F.count("_ext") > 0).alias("_has"), F.lit(1).alias("_one"))
    return (
        joined.withColumn("_one", F.lit(1)).join(F.broadcast(any_ext), "_one")
        .withColumn(out, F.when(F.col("_has"), F.col("_ext")).otherwise(own)).drop("_one", "_has", "_ext")
    )


def label_mode(df: DataFrame, label: str = "label") -> DataFrame:
    """One row: method, samples, true anomalies."""
    return df.agg(
        F.when(F.count(label) > 0, F.lit("supervised")).otherwise(F.lit("unsupervised")).alias("method"),
        F.count(F.lit(1)).alias("n_samples"),
        F.count_if(F.col(label) == 1).alias("n_true_anomalies"),
    )


def confusion_counts(df: DataFrame, cuts: Sequence[Column], names: Sequence[float], score: str = "anomaly_score",
                     label: str | None = "is_anomaly") -> DataFrame:
    """``pos, threshold, cut, tp, fp, fn, n_flagged, n, n_pos, n_neg`` per cut.

    One aggregate; a missing score counts as zero.
    """
    s = F.coalesce(F.col(score).cast("double"), F.lit(0.0))
    y = F.col(label) if label else F.lit(None).cast("int")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(y == 1).alias("n_pos"),
        F.count_if(y == 0).alias("n_neg"),
    ]
    for i, cut in enumerate(cuts):
        aggs += [
            F.count_if(s >= cut).alias(f"_all{i}"),
            F.count_if((s >= cut) & (y == 1)).alias(f"_tp{i}"),
            F.count_if((s >= cut) & (y == 0)).alias(f"_fp{i}"),
            F.first(cut).alias(f"_cut{i}"),
        ]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("pos"), F.lit(float(v)).alias("threshold"), F.col(f"_cut{i}").alias("cut"),
            F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"), F.col(f"_all{i}").alias("n_flagged"))
        for i, v in enumerate(names)]))
    return one.select("n", "n_pos", "n_neg", rows.alias("r")).select("n", "n_pos", "n_neg", "r.*").withColumn(
        "fn", F.col("n_pos") - F.col("tp"))


def with_metrics(counts: DataFrame, undefined_precision: float | None = 0.0, digits: int | None = 6) -> DataFrame:
    p = ratio(F.col("tp"), F.col("tp") + F.col("fp"), undefined_precision)
    r = ratio(F.col("tp"), F.col("n_pos"), 0.0)
    df = counts.withColumns({"precision": p, "recall": r})
    pr = F.col("precision") + F.col("recall")
    f1 = F.when(pr > 0, 2.0 * F.col("precision") * F.col("recall") / F.when(pr > 0, pr)).otherwise(F.lit(0.0))
    df = df.withColumn("f1", f1)
    if digits is None:
        return df
    return df.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def supervised_sweep(df: DataFrame, grid: Sequence[float] = CalibrationConfig().grid, score: str = "anomaly_score",
                     label: str = "is_anomaly") -> DataFrame:
    counts = confusion_counts(df, [F.lit(float(t)) for t in grid], grid, score, label)
    return with_metrics(counts).select(
        "pos", "threshold", "precision", "recall", "f1", "tp", "fp", "fn", "n_flagged",
        F.round(F.col("n_flagged") / F.greatest(F.col("n"), F.lit(1)), 6).alias("flag_rate"))


def unsupervised_sweep(df: DataFrame, grid: Sequence[float] = CalibrationConfig().grid,
                       score: str = "anomaly_score") -> DataFrame:
    counts = confusion_counts(df, [F.lit(float(t)) for t in grid], grid, score, None)
    return counts.select(
        "pos", "threshold", "n_flagged", F.round(F.col("n_flagged") / F.greatest(F.col("n"), F.lit(1)), 6).alias("flag_rate"))


def rate_threshold(df: DataFrame, rate: float = 0.05, score: str = "anomaly_score") -> DataFrame:
    """Score cut that flags ``rate`` of the rows, kept inside [0.01, 0.99]."""
    filled = df.select(F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("_s"))
    q = score_quantiles(filled, "_s", [1.0 - rate])
    return q.select(F.least(F.greatest(F.col("quantiles")[0], F.lit(0.01)), F.lit(0.99)).alias("threshold"))


def pick_threshold(sweep: DataFrame, metric: str = "f1", min_recall: float = 0.20, min_precision: float = 0.10,
                   tie: str = "auto") -> DataFrame:
    """Best row of a sweep (a table the size of its grid).

    ``tie='auto'``: equal values go to the higher threshold, for a recall
    target to the lower one. ``tie='first'``: to the earliest grid position.
    A recall or precision floor that nothing meets is ignored.
    """
    floor = {
        "precision": F.col("recall") >= min_recall,
        "recall": F.col("precision") >= min_precision,
    }.get(metric, F.lit(True))
    if tie == "first":
        second = F.col("pos").asc()
    else:
        second = F.col("threshold").asc() if metric == "recall" else F.col("threshold").desc()
    # rows meeting the floor sort before all others, so "relax" needs no second pass
    return sweep.orderBy(F.when(floor, 0).otherwise(1), F.round(metric, 9).desc(), second).limit(1)


def contamination_sweep(df: DataFrame, grid: Sequence[float] = TunerConfig().contamination_grid,
                        score: str = "if_score", label: str | None = "is_anomaly") -> DataFrame:
    """Confusion counts when the top fraction ``c`` of a detector score is flagged."""
    filled = df.withColumn("_s", F.round(F.coalesce(F.col(score).cast("double"), F.lit(0.0)), 6))
    cuts = score_quantiles(filled, "_s", [1.0 - c for c in grid], alias="_cuts").withColumn("_one", F.lit(1))
    joined = filled.withColumn("_one", F.lit(1)).join(F.broadcast(cuts), "_one")
    counts = confusion_counts(joined, [F.col("_cuts")[i] for i in range(len(grid))], grid, "_s", label)
    if label is None:
        return counts.select("pos", F.col("threshold").alias("contamination"), "cut", "n_flagged")
    return with_metrics(counts, digits=None).select(
        "pos", F.col("threshold").alias("contamination"), "threshold", "cut", "precision", "recall", "f1",
        "tp", "fp", "fn", "n_flagged")


def threshold_sweep(df: DataFrame, cfg: TunerConfig = TunerConfig(), score: str = "anomaly_score",
                    label: str = "is_anomaly") -> DataFrame:
    counts = confusion_counts(df, [F.lit(float(t)) for t in cfg.threshold_grid], cfg.threshold_grid, score, label)
    return with_metrics(counts, digits=None).select(
        "pos", "threshold", "precision", "recall", "f1", "tp", "fp", "fn", "n_flagged")


def recommend(df: DataFrame, cfg: TunerConfig = TunerConfig(), current_contamination: float = 0.05,
              current_threshold: float = 0.55, label: str = "is_anomaly") -> DataFrame:
    """One row: recommended contamination and threshold with the F1 reached.

    Falls back to the expected rate when there is no detector score and to the
    default threshold when there is no score at all. Without any label the
    answer is the unsupervised one.
    """
    if label not in df.columns:
        df = df.withColumn(label, F.lit(None).cast("int"))
    free = recommend_unsupervised(df, cfg).select(
        F.col("recommended_contamination").alias("_ucont"), F.col("recommended_threshold").alias("_uthr"), F.lit(1).alias("_one"))
    has = df.agg(
        (F.count(label) > 0).alias("_sup"),
        (F.count("if_score") > 0).alias("_if"), (F.count("anomaly_score") > 0).alias("_any"), F.lit(1).alias("_one"))
    cont = pick_threshold(contamination_sweep(df, cfg.contamination_grid, label=label), cfg.metric, cfg.min_recall,
                          cfg.min_precision, "first").select("contamination", F.lit(1).alias("_one"))
    thr = pick_threshold(threshold_sweep(df, cfg, label=label), cfg.metric, cfg.min_recall, cfg.min_precision,
                         "first").select(F.col("threshold").alias("_thr"), F.col("f1").alias("_f1"), F.lit(1).alias("_one"))
    # four single-row frames
    one = has.join(F.broadcast(cont), "_one", "left").join(F.broadcast(thr), "_one", "left").join(F.broadcast(free), "_one", "left")
    sup = F.col("_sup")
    return one.select(
        F.lit(current_contamination).alias("current_contamination"),
        F.when(~sup, F.col("_ucont")).otherwise(
            F.round(F.when(F.col("_if"), F.col("contamination")).otherwise(F.lit(cfg.expected_rate)), 6))
        .alias("recommended_contamination"),
        F.lit(current_threshold).alias("current_threshold"),
        F.when(~sup, F.col("_uthr")).otherwise(
            F.round(F.when(F.col("_any"), F.col("_thr")).otherwise(F.lit(cfg.default_threshold)), 6))
        .alias("recommended_threshold"),
        F.round(F.when(sup & F.col("_any"), F.col("_f1")), 6).alias("f1_at_recommended"),
        F.when(sup, F.lit("supervised")).otherwise(F.lit("unsupervised")).alias("method"),
    )


def recommend_unsupervised(df: DataFrame, cfg: TunerConfig = TunerConfig()) -> DataFrame:
    """Expected rate as contamination, percentile cut as threshold."""
    return rate_threshold(df, cfg.expected_rate).select(
        F.lit(min(max(cfg.expected_rate, 0.001), 0.499)).alias("recommended_contamination"),
        F.round("threshold", 6).alias("recommended_threshold"), F.lit("unsupervised").alias("method"))


def resolve_threshold(calibration: DataFrame | None, explicit: float | None, default: float = 0.55, *,
                      like: DataFrame) -> DataFrame:
    """One row ``threshold, source``: explicit value, else the calibration's, else the default."""
    if calibration is None:
        calibration = like.sparkSession.createDataFrame([], "threshold DOUBLE")
    found = F.max("threshold")
    given = F.lit(explicit).cast("double")
    return calibration.agg(
        F.coalesce(given, found, F.lit(default)).alias("threshold"),
        F.when(given.isNotNull(), F.lit("explicit")).when(found.isNotNull(), F.lit("calibration"))
        .otherwise(F.lit("fallback")).alias("source"))


# -- reports ---------------------------------------------------------------------------


def score_distribution(df: DataFrame, signals: Sequence[str] = SIGNAL_COLUMNS) -> DataFrame:
    """Count, mean, sample std, percentiles and maximum per signal column."""
    used = [c for c in signals if c in df.columns]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("signal"), F.round(F.col(c).cast("double"), 6).alias("s")) for c in used])).alias("r"))
    cells = long.select("r.*").filter(F.col("s").isNotNull()).groupBy("signal", "s").agg(F.count(F.lit(1)).alias("c"))
    n, mean = F.sum("c"), F.sum(F.col("s") * F.col("c")) / F.sum("c")
    probs = [0.25, 0.50, 0.75, 0.90, 0.95, 0.99]
    out = cells.groupBy("signal").agg(
        n.alias("n_valid"), mean.alias("mean"),
        F.sum(F.col("s") * F.col("s") * F.col("c")).alias("_sq"),
        F.percentile("s", F.array(*[F.lit(p) for p in probs]), F.col("c")).alias("_q"),
        F.max("s").alias("max"),
    )
    var = (F.col("_sq") - F.col("n_valid") * F.col("mean") * F.col("mean")) / F.when(F.col("n_valid") > 1, F.col("n_valid") - 1)
    return out.select(
        "signal", "n_valid", "mean", F.coalesce(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)).alias("std"),
        *[F.col("_q")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(probs)], "max")


def sensitivity(df: DataFrame, grid: Sequence[float] = SENSITIVITY_GRID) -> DataFrame:
    counts = confusion_counts(df, [F.lit(float(t)) for t in grid], grid, label=None)
    return counts.select(
        "threshold", "n_flagged", "n",
        (F.col("n_flagged") / F.greatest(F.col("n"), F.lit(1)) * 100.0).alias("pct_flagged"))


def metrics_at(df: DataFrame, threshold: float, label: str = "is_anomaly", undefined_precision: float = 0.0) -> DataFrame:
    """Confusion counts, precision, recall, F1, accuracy, false-positive rate."""
    m = with_metrics(confusion_counts(df, [F.lit(float(threshold))], [threshold], label=label), undefined_precision)
    tn = F.col("n_neg") - F.col("fp")
    return m.select(
        "threshold", F.col("n").alias("n_total"), F.col("n_neg").alias("n_normal"), F.col("n_pos").alias("n_anomaly"),
        "tp", "fp", "fn", tn.alias("tn"), "precision", "recall", "f1",
        F.round((F.col("tp") + tn) / F.greatest(F.col("n"), F.lit(1)), 6).alias("accuracy"),
        F.round(ratio(F.col("fp"), F.col("n_neg")), 6).alias("false_positive_rate"),
        F.round(F.lit(100.0) * F.col("n_pos") / F.greatest(F.col("n"), F.lit(1)), 4).alias("true_anomaly_rate"))


def recall_by_type(df: DataFrame, threshold: float) -> DataFrame:
    """Detected share per anomaly type that occurs among true anomalies."""
    hit = F.col("anomaly_score") >= F.lit(threshold)
    return (
        df.filter(F.col("anomaly_type") != "normal").groupBy("anomaly_type").agg(
            F.count(F.lit(1)).alias("n_total"), F.count_if(hit).alias("n_detected"),
            F.count_if(F.col("is_anomaly") == 1).alias("_true"))
        .filter(F.col("_true") > 0)
        .select("anomaly_type", "n_total", "n_detected", F.round(F.col("n_detected") / F.col("n_total"), 6).alias("recall"))
    )


def signal_separation(df: DataFrame, signals: Sequence[str] = SIGNAL_COLUMNS) -> DataFrame:
    """Mean per class and their difference for each signal."""
    used = [c for c in signals if c in df.columns]
    long = df.select("is_anomaly", F.explode(F.array(*[
        F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("s")) for c in used])).alias("r"))
    y = F.col("is_anomaly")
    return long.groupBy(F.col("r.signal").alias("signal")).agg(
        F.avg(F.when(y == 0, F.col("r.s"))).alias("_n"), F.avg(F.when(y == 1, F.col("r.s"))).alias("_a"),
    ).select(
        "signal", F.round("_n", 6).alias("mean_normal"), F.round("_a", 6).alias("mean_anomaly"),
        F.round(F.col("_a") - F.col("_n"), 6).alias("separation"))


def fp_curve(df: DataFrame, grid: Sequence[float] = FP_CURVE_GRID) -> DataFrame:
    """Flagged, false and true positives per threshold; undefined precision is NULL."""
    counts = confusion_counts(df, [F.lit(float(t)) for t in grid], grid)
    return counts.select(
        F.round("threshold", 4).alias("threshold"), "n_flagged", "fp", "tp",
        F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp"), None), 6).alias("precision"),
        F.round(F.col("fp") / F.greatest(F.col("n_neg"), F.lit(1)), 6).alias("fp_rate"))


CASE_COLUMNS = ("row_id", *KEYS, "bucket", "total_cost", "anomaly_score", "anomaly_type")


def top_cases(df: DataFrame, label: int, flagged: bool, threshold: float, k: int = 10, lowest: bool = False) -> DataFrame:
    """The k highest (or lowest) scored rows of one confusion cell.

    Covers realised false positives (0, flagged), borderline normals (0, not
    flagged), near misses (1, not flagged) and deep misses (same, lowest).
    """
    score = F.col("anomaly_score")
    side = score >= F.lit(threshold) if flagged else score < F.lit(threshold)
    order = score.asc() if lowest else score.desc()
    rows = df.filter((F.col("is_anomaly") == label) & side).orderBy(order, F.col("row_id").asc()).limit(k)
    return rows.select(*[
        F.round(c, 6).alias(c) if c == "anomaly_score" else F.round(c, 4).alias(c) if c == "total_cost" else F.col(c)
        for c in CASE_COLUMNS if c in df.columns])


def slice_risk(df: DataFrame, threshold: float, dims: Sequence[str] = KEYS, digits: int = 6) -> DataFrame:
    """False-positive risk of the normal rows per value of each dimension.

    Equal scores are counted before the shuffle on (dimension, value), so a
    value with most of the rows arrives as at most a million counts.
    """
    normals = df.filter(F.col("is_anomaly") == 0).select(
        F.round("anomaly_score", 6).alias("s"),
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]))
        .alias("d"))
    cells = normals.groupBy("d.dimension", "d.value", "s").agg(F.count(F.lit(1)).alias("c"))
    return cells.groupBy("dimension", "value").agg(
        F.sum("c").alias("n_normal"),
        F.sum(F.when(F.col("s") >= F.lit(threshold), F.col("c")).otherwise(F.lit(0))).alias("fp_at_current"),
        F.round(F.sum(F.col("s") * F.col("c")) / F.sum("c"), digits).alias("mean_score_normal"),
        F.round(F.percentile("s", F.lit(0.95), F.col("c")), digits).alias("p95_score_normal"),
        F.round(F.max("s"), digits).alias("max_score_normal"),
    ).orderBy("dimension", F.col("mean_score_normal").desc(), "value")


def missed_by_type(df: DataFrame, threshold: float) -> DataFrame:
    s = F.col("anomaly_score")
    out = df.filter((F.col("is_anomaly") == 1) & (F.col("anomaly_type") != "normal")).groupBy("anomaly_type").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(s < F.lit(threshold)).alias("n_missed"),
        F.round(F.avg(s), 6).alias("mean_score"), F.round(F.max(s), 6).alias("max_score"),
        F.round(F.min(s), 6).alias("min_score"))
    return out.withColumn("miss_rate", F.round(F.col("n_missed") / F.col("n_total"), 6)).orderBy(
        F.col("miss_rate").desc(), "anomaly_type")


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("count"))
