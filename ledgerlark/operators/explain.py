"""Explanations of scored buckets: forecast, rules, score breakdown, payload.

Everything is a column expression over the scored frame; nothing leaves the
JVM. Text uses two decimals for money and one for percentages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import RuleConfig, ScoringConfig, SIGNAL_COLUMNS
from ..functions.exprs import nan_to_null

# Fixed display names of the score components.
COMPONENT_LABELS = {
    "ts_signal": "Time-Series Signal",
    "if_score": "Isolation Forest",
    "rule_score": "Rule Engine",
}


def _fmt(pattern: str, *cols: Column) -> Column:
    return F.format_string(pattern, *cols)


def direction_of(residual: Column) -> Column:
    return (
        F.when(residual > 0, F.lit("above"))
        .when(residual < 0, F.lit("below"))
        .when(residual == 0, F.lit("within"))
        .otherwise(F.lit("unknown"))
    )


def explain_forecast(df: DataFrame, target: str = "total_cost", levels: Sequence[int] = (95,),
                     prefix: str = "exp_") -> DataFrame:
    """``exp_direction, exp_pct_deviation, exp_z_score, exp_ci_breach, exp_summary``.

    Residual, z-score and breach flags are read when present and derived from
    the forecast and bounds when not.
    """
    have = set(df.columns)

    def col_or_null(name: str) -> Column:
        return nan_to_null(F.col(name).cast("double")) if name in have else F.lit(None).cast("double")

    actual = F.col(target).cast("double")
    mean, std = col_or_null("forecast_mean"), col_or_null("forecast_std")
    residual = F.coalesce(col_or_null("residual"), actual - mean)
    z = F.coalesce(col_or_null("z_score"), residual / F.when(std != 0, std))
    base = df.withColumns({
        "_residual": residual,
        f"{prefix}z_score": z,
        f"{prefix}pct_deviation": residual / F.abs(F.when(mean != 0, mean)) * F.lit(100.0),
        f"{prefix}direction": direction_of(residual),
    })
    breaches: dict[int, Column] = {}
    for p in levels:
        derived = (
            (actual < F.col(f"ci_lower_{p}")) | (actual > F.col(f"ci_upper_{p}"))
            if {f"ci_lower_{p}", f"ci_upper_{p}"} <= have else F.lit(None).cast("boolean")
        )
        stored = F.col(f"is_outside_ci_{p}") == 1 if f"is_outside_ci_{p}" in have else F.lit(None).cast("boolean")
        breaches[p] = F.coalesce(stored, derived, F.lit(False))

    pct, way = F.col(f"{prefix}pct_deviation"), F.col(f"{prefix}direction")
    core = F.when(
        pct.isNull(),
        _fmt(f"Actual {target} (%.2f) is %s the forecast (%.2f) by %.2f units", actual, way, mean, F.abs(actual - mean)),
    ).otherwise(
        _fmt(f"Actual {target} (%.2f) is %.1f%% %s the forecast (%.2f)", actual, F.abs(pct), way, mean))
    spread = F.when(
        F.col(f"{prefix}z_score").isNotNull(),
        _fmt(", a deviation of %.1f standard deviations", F.abs(F.col(f"{prefix}z_score")))).otherwise(F.lit(""))
    hit = F.array_compact(F.array(*[F.when(breaches[p], F.lit(f"{p}%")) for p in sorted(levels)])) if levels else None
    breach_text = (
        F.when(F.size(hit) > 0, F.concat(
            F.lit(", breaching the "), F.array_join(hit, ", "), F.lit(" confidence interval"))).otherwise(F.lit(""))
        if levels else F.lit("")
    )
    summary = F.when(
        mean.isNull(), _fmt(f"Forecast data unavailable; actual {target} was %.2f.", actual)
    ).otherwise(F.concat(core, spread, breach_text, F.lit(".")))
    return base.withColumns({
        f"{prefix}ci_breach": breaches[levels[0]] if levels else F.lit(False),
        f"{prefix}summary": summary,
    }).drop("_residual")


def explain_rules(df: DataFrame, cfg: RuleConfig = RuleConfig(), prefix: str = "exp_rule_") -> DataFrame:
    """Fired, score and reason per rule, triggered list and summary.

    Reads the columns left by ``rules.apply_rules``.
    """
    x = F.col(cfg.target).cast("double")
    limit, need = F.lit(cfg.budget_limit), cfg.sustained_window + 1
    threshold_reason = F.when(
        F.col("threshold_fired") == 1,
        _fmt("Value %.2f exceeds budget limit %.2f by %.1f%%.", x, limit, F.col("threshold_over") * 100.0),
    ).otherwise(_fmt("Value %.2f within budget limit %.2f.", x, limit))
    mean, pct, jump = F.col("jump_mean"), F.col("jump_pct"), F.lit(cfg.jump_pct * 100.0)
    jump_reason = (
        F.when(mean.isNull(), F.lit("Insufficient history for sudden-jump evaluation."))
        .when((mean == 0) & (x > 0), _fmt(
            "Window mean is zero and current value is %.2f — any positive spend from a zero baseline is a maximum anomaly.", x))
        .when(mean == 0, F.lit("Window mean and current value are both zero; no jump detected."))
        .when(F.col("jump_fired") == 0, _fmt("Jump of %.1f%% is below threshold %.1f%%.", pct * 100.0, jump))
        .otherwise(_fmt(
            "Sudden jump of %.1f%% detected (threshold %.1f%%, window mean %.2f).", pct * 100.0, jump, mean))
    )
    growth = F.lit(cfg.sustained_min_growth * 100.0)
    sustained_reason = (
        F.when(F.col("sustained_seen") < need, _fmt(
            f"Need at least {need} observations, got %d.", F.col("sustained_seen")))
        .when(F.col("sustained_fired") == 1, _fmt(
            f"All {cfg.sustained_window} consecutive periods grew by ≥%.1f%% — sustained upward trend detected.", growth))
        .otherwise(_fmt(
            f"Only %d/{cfg.sustained_window} periods met the %.1f%% growth threshold.",
            F.col("sustained_passing"), growth))
    )
    reasons = {"threshold": threshold_reason, "jump": jump_reason, "sustained": sustained_reason}
    names = {"threshold": "threshold_breach", "jump": "sudden_jump", "sustained": "sustained_increase"}
    cols = {}
    for short, reason in reasons.items():
        cols[f"{prefix}{short}_fired"] = F.col(f"{short}_fired") == 1
        cols[f"{prefix}{short}_score"] = F.col(f"{short}_score")
        cols[f"{prefix}{short}_reason"] = reason
    out = df.withColumns(cols)

    def fired_list(value):
        return F.array_compact(F.array(*[
            F.when(F.col(f"{prefix}{short}_fired"), value(short)) for short in reasons]))

    fired = fired_list(lambda s: F.lit(names[s]))
    details = fired_list(lambda s: F.concat(F.lit(f"{names[s]} — "), F.col(f"{prefix}{s}_reason")))
    count = F.size(fired)
    return out.withColumns({
        f"{prefix}triggered_rules": F.array_join(fired, ", "),
        f"{prefix}summary": F.when(count == 0, F.lit("No rules triggered.")).otherwise(F.concat(
            F.when(count == 1, F.lit("1 rule triggered")).otherwise(F.concat(count.cast("string"), F.lit(" rules triggered"))),
            F.lit(": "), F.array_join(details, "; "))),
    })


def score_breakdown(df: DataFrame, cfg: ScoringConfig = ScoringConfig(), out: str = "exp_components") -> DataFrame:
    """Array of component structs; their contributions add up to the score."""
    weights = cfg.weights()
    raw = {}
    for name in weights:
        c = nan_to_null(F.col(name).cast("double")) if name in df.columns else F.lit(None).cast("double")
        raw[name] = F.coalesce(c, F.lit(0.0)) if name == "rule_score" else c
    total = sum((F.when(raw[n].isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for n, w in weights.items()), F.lit(0.0))
    base = df.withColumn("_active_weight", total)
    parts = []
    for name, w in weights.items():
        active = raw[name].isNotNull() & F.lit(w > 0.0)
        effective = F.when(active & (F.col("_active_weight") > 0), F.lit(w) / F.when(
            F.col("_active_weight") > 0, F.col("_active_weight"))).otherwise(F.lit(0.0))
        parts.append(F.struct(
            F.lit(name).alias("name"),
            F.lit(COMPONENT_LABELS[name]).alias("label"),
            raw[name].alias("raw_score"),
            F.lit(w).alias("configured_weight"),
            effective.alias("effective_weight"),
            F.when(active, effective * raw[name]).otherwise(F.lit(0.0)).alias("weighted_contribution"),
            active.alias("active"),
        ))
    return base.withColumn(out, F.array(*parts)).drop("_active_weight")


def explanation_payload(df: DataFrame, cfg: ScoringConfig = ScoringConfig(), target: str = "total_cost",
                        levels: Sequence[int] = (95,), out: str = "exp_breakdown") -> DataFrame:
    """Nested struct with rounded numbers; forecast and rule parts if present."""
    if "exp_components" not in df.columns:
        df = score_breakdown(df, cfg)
    have = set(df.columns)
    components = F.transform("exp_components", lambda c: F.struct(
        c["name"].alias("name"), c["label"].alias("label"),
        F.round(c["raw_score"], 6).alias("raw_score"),
        F.round(c["configured_weight"], 6).alias("configured_weight"),
        F.round(c["effective_weight"], 6).alias("effective_weight"),
        F.round(c["weighted_contribution"], 6).alias("weighted_contribution"),
        c["active"].alias("active"),
    ))
    fields = [
        F.round("anomaly_score", 6).alias("anomaly_score"),
        F.lit(round(cfg.threshold, 6)).alias("anomaly_threshold"),
        (F.col("is_anomaly") == 1).alias("is_anomaly"),
        (F.col("severity") if "severity" in have else F.lit(None).cast("string")).alias("severity"),
        components.alias("components"),
    ]
    if {"exp_direction", "exp_summary"} <= have:
        def num(name: str, digits: int) -> Column:
            return F.round(F.col(name), digits) if name in have else F.lit(None).cast("double")

        flags = [x for p in levels if f"is_outside_ci_{p}" in have
                 for x in (F.lit(str(p)), F.col(f"is_outside_ci_{p}") == 1)]
        breaches = F.create_map(*flags) if flags else F.create_map().cast("map<string,boolean>")
        fields.append(F.struct(
            F.round(target, 6).alias("actual"),
            num("forecast_mean", 6).alias("forecast_mean"),
            num("forecast_std", 6).alias("forecast_std"),
            num("residual", 6).alias("residual"),
            num("exp_pct_deviation", 4).alias("pct_deviation"),
            num("exp_z_score", 4).alias("z_score"),
            F.col("exp_direction").alias("direction"),
            breaches.alias("ci_breaches"),
            F.col("exp_summary").alias("summary"),
        ).alias("forecast_explanation"))
    if "exp_rule_threshold_fired" in have:
        def rule(short: str, name: str) -> Column:
            return F.struct(
                F.lit(name).alias("rule"),
                F.col(f"exp_rule_{short}_fired").alias("fired"),
                F.round(f"exp_rule_{short}_score", 6).alias("score"),
                F.col(f"exp_rule_{short}_reason").alias("reason"),
            ).alias(name)

        triggered = F.filter(F.split("exp_rule_triggered_rules", ", "), lambda t: t != "")
        fields.append(F.struct(
            rule("threshold", "threshold_breach"), rule("jump", "sudden_jump"), rule("sustained", "sustained_increase"),
            triggered.alias("triggered_rules"),
            F.col("exp_rule_summary").alias("summary"),
        ).alias("rule_explanation"))
    return df.withColumn(out, F.struct(*fields))


def payload_json(column: str = "exp_breakdown") -> Column:
    """JSON text of the payload; missing numbers stay as explicit nulls."""
    return F.to_json(F.col(column), {"ignoreNullFields": "false"})


COMPONENT_FIELDS = ("name", "label", "configured_weight", "effective_weight", "weighted_contribution", "active")
RULE_NAMES = ("threshold_breach", "sudden_jump", "sustained_increase")


def payload_errors(column: str = "exp_breakdown", parts: Sequence[str] = ("forecast_explanation", "rule_explanation")) -> Column:
    """Contract check: the paths that break it, an empty array when the payload is valid.

    Scores lie in [0, 1]; severity and direction come from fixed sets; the three
    components are there in their order, with all numbers but the raw score.
    ``parts`` names the optional fields that the payload has; one that is not
    NULL must be complete.
    """
    p = F.col(column)

    def bad(when: Column, path: str) -> Column:
        # an unknown condition breaks the contract too
        return F.when(F.coalesce(when, F.lit(True)), F.lit(path))

    def unit(value: Column, path: str) -> Column:
        return bad(F.isnan(value.cast("double")) | (value < 0) | (value > 1), path)

    def lacks(field: str):
        return lambda c: c[field].isNull()

    checks = [
        unit(p["anomaly_score"], "anomaly_score"), unit(p["anomaly_threshold"], "anomaly_threshold"), bad(p["is_anomaly"].isNull(), "is_anomaly"),
        bad(p["severity"].isNotNull() & ~F.coalesce(p["severity"], F.lit("none")).isin("none", "low", "medium", "high"), "severity"),
        bad(~F.transform(p["components"], lambda c: c["name"]).eqNullSafe(F.array(*[F.lit(n) for n in COMPONENT_LABELS])), "components"),
        *[bad(F.exists(p["components"], lacks(f)), f"components.{f}") for f in COMPONENT_FIELDS],
        bad(F.exists(p["components"], lambda c: ~F.coalesce(c["effective_weight"], F.lit(0.0)).between(0, 1)), "components.effective_weight"),
    ]
    if "forecast_explanation" in parts:
        f = p["forecast_explanation"]
        found = [
            *[bad(f[c].isNull(), f"forecast_explanation.{c}") for c in ("actual", "summary")],
            bad(~f["direction"].isin("above", "below", "within", "unknown"), "forecast_explanation.direction"),
            bad(F.exists(F.map_values(f["ci_breaches"]), lambda x: x.isNull()), "forecast_explanation.ci_breaches"),
        ]
        checks += [F.when(f.isNotNull(), c) for c in found]
    if "rule_explanation" in parts:
        r = p["rule_explanation"]
        found = [bad(r[c].isNull(), f"rule_explanation.{c}") for c in ("triggered_rules", "summary")]
        for name in RULE_NAMES:
            path = f"rule_explanation.{name}"
            found += [bad(r[name][c].isNull(), f"{path}.{c}") for c in ("rule", "fired", "reason")]
            found.append(unit(r[name]["score"], f"{path}.score"))
        checks += [F.when(r.isNotNull(), c) for c in found]
    return F.array_distinct(F.array_compact(F.array(*checks)))


def pick_examples(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One illustrative row per case, chosen in a single aggregation.

    ``df`` holds ``is_anomaly`` (flagged), ``anomaly_type`` and
    ``exp_rule_triggered_rules``. Ties go to the smallest row id.
    """
    score = F.col("anomaly_score")
    normal = F.col("anomaly_type") == "normal"
    breach = F.col("anomaly_type") == "budget_breach"
    with_rule = breach & (F.length(F.coalesce("exp_rule_triggered_rules", F.lit(""))) > 0)
    flagged = F.col("is_anomaly") == 1

    def best(cond: Column, key: Column) -> Column:
        """Row whose ordering key is smallest among the rows meeting ``cond``."""
        return F.min_by(
            F.struct(F.col(row_id).alias(row_id), score.alias("anomaly_score"),
                     F.col("anomaly_type").alias("anomaly_type"), F.col("is_anomaly").alias("is_anomaly")),
            F.when(cond, F.struct(key.alias("k"), F.col(row_id).alias("i"))))

    high, low = -score, score
    picks = df.agg(
        best(flagged & (F.col("anomaly_type") == "spike"), high).alias("high_confidence_spike"),
        F.coalesce(best(with_rule, high), best(breach, high)).alias("sustained_budget_breach"),
        best(~flagged & normal, high).alias("borderline_normal"),
        best(normal, low).alias("calm_normal"),
        best(~flagged & ~normal, low).alias("missed_anomaly"),
    )
    cases = picks.columns
    return picks.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("case"), F.col(c).alias("row")) for c in cases])).alias("p")).filter(
        F.col("p.row").isNotNull()).select("p.case", "p.row.*")


__all__ = [
    "SIGNAL_COLUMNS", "direction_of", "explain_forecast", "explain_rules", "explanation_payload",
    "payload_errors", "payload_json", "pick_examples", "score_breakdown",
]
