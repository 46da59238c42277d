"""Alert derivation: channel expansion, dedup, cooldown, record assembly."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..config import KEYS, AlertConfig
from ..functions.exprs import join_on

_FAR_PAST = np.iinfo(np.int64).min // 4


def expand_channels(anomalies: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One row per anomaly and channel with its ``dedup_key``."""
    return anomalies.withColumn("channel", F.explode(F.array(*[F.lit(c) for c in channels]))).withColumn(
        "dedup_key", F.concat_ws(":", "anomaly_id", "channel"))


def drop_known(pairs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Pairs whose ``dedup_key`` has no alert yet."""
    return pairs.join(alerts.select("dedup_key"), "dedup_key", "left_anti")


def last_alerted(alerts: DataFrame, at: str = "created_at") -> DataFrame:
    """Last time each series was alerted (suppressed records do not count)."""
    return alerts.filter(F.col("status") != "suppressed").groupBy(*KEYS).agg(F.max(at).alias("last_alerted"))


def cooldown(
    events: DataFrame,
    cfg: AlertConfig = AlertConfig(),
    state: DataFrame | None = None,
    at: str = "detected_at",
    event_id: str = "anomaly_id",
    keys: Sequence[str] = KEYS,
    chunk_seconds: int = 7 * 86_400,
) -> DataFrame:
    """Add ``suppressed``: less than the cooldown after the series' last alert.

    The decision is sequential per series, but the time axis is cut into
    chunks and no task sees more than one chunk of a series. Within a chunk the
    outcome depends only on the last alert before it, so each chunk is first
    summarised as a step function (last alert before -> last alert after); the
    summaries are chained per series (one row per chunk); then every chunk is
    resolved on its own. Same-time events of a series count as one, the
    smallest id being the one alerted. ``state`` holds ``last_alerted`` per
    series from earlier runs.
    """
    keys = list(keys)
    gap = cfg.cooldown_seconds * 1_000_000
    size = max(chunk_seconds, cfg.cooldown_seconds) * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    times = (
        events.groupBy(*keys, micros.alias("_t")).agg(F.min(event_id).alias("_first"))
        .withColumn("_chunk", F.floor(F.col("_t") / F.lit(size)))
    )
    if state is not None:
        # events inside the remembered cooldown are suppressed; on later ones it has no effect
        since = state.select(*keys, F.unix_micros(F.col("last_alerted").cast("timestamp")).alias("_since"))
        times = join_on(times, since, keys, "left").filter(
            F.col("_since").isNull() | (F.col("_t") - F.col("_since") >= gap)).drop("_since")
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in times.schema if f.name in keys)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        nxt = np.searchsorted(t, t + gap)
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        # reachable starts: an alert before the chunk blocks at most `gap` into it
        reach = np.searchsorted(t, int(pdf["_chunk"].iloc[0]) * size + gap) + 1
        t, last = t[:reach], last[:reach]
        ends = np.append(last[1:] != last[:-1], True)
        row = pdf[[*keys, "_chunk"]].iloc[:1].copy()
        row["_upto"], row["_exit"] = [t[ends].tolist()], [last[ends].tolist()]
        return row

    summaries = times.groupBy(*keys, "_chunk").applyInPandas(
        summarise, f"{key_types}, _chunk long, _upto array<long>, _exit array<long>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk", ignore_index=True)
        last, entry = _FAR_PAST, []
        for upto, after in zip(pdf["_upto"], pdf["_exit"]):
            entry.append(last)
            i = np.searchsorted(np.asarray(upto), last + gap)
            if i < len(upto):
                last = int(after[i])
        out = pdf[[*keys, "_chunk"]].copy()
        out["_entry"] = entry
        return out

    entries = summaries.groupBy(*keys).applyInPandas(chain, f"{key_types}, _chunk long, _entry long")

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_t", ignore_index=True)
        t = pdf["_t"].to_numpy()
        i = np.searchsorted(t, int(pdf["_entry"].iloc[0]) + gap)
        hits = []
        while i < len(t):
            hits.append(i)
            i = np.searchsorted(t, t[i] + gap)
        return pdf.iloc[hits][[*keys, "_t", "_first"]]

    id_type = times.schema["_first"].dataType.simpleString()
    alerted = (
        join_on(times, entries, [*keys, "_chunk"]).groupBy(*keys, "_chunk")
        .applyInPandas(resolve, f"{key_types}, _t long, _first {id_type}")
    )
    return (
        join_on(events.withColumn("_t", micros), alerted, [*keys, "_t"], "left")
        .withColumn("suppressed", ~F.coalesce(F.col("_first") == F.col(event_id), F.lit(False)))
        .drop("_t", "_first")
    )


def alert_records(pairs: DataFrame, outcomes: DataFrame | None, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Alert rows of decided pairs.

    ``outcomes`` reports deliveries by ``dedup_key``: ``delivered_at`` when sent
    or ``error`` when it failed. A pair without an outcome is still pending.
    """
    if outcomes is None:
        joined = pairs.withColumns({
            "delivered_at": F.lit(None).cast("timestamp"), "error": F.lit(None).cast("string")})
    else:
        joined = pairs.join(outcomes.select("dedup_key", "delivered_at", "error"), "dedup_key", "left")
    status = (
        F.when(F.col("suppressed"), F.lit("suppressed"))
        .when(F.col("delivered_at").isNotNull(), F.lit("sent"))
        .when(F.col("error").isNotNull(), F.lit("failed"))
        .otherwise(F.lit("pending"))
    )
    return joined.withColumn("status", status).select(
        F.md5("dedup_key").alias("alert_id"), "anomaly_id", *KEYS, "severity", "channel", "status", "dedup_key",
        F.col("detected_at").alias("created_at"),
        F.when(F.col("status") == "sent", F.col("delivered_at")).alias("sent_at"),
        F.when(F.col("status") == "failed", F.substring("error", 1, cfg.error_length)).alias("error_detail"),
    )


def derive_alerts(anomalies: DataFrame, alerts: DataFrame | None = None, outcomes: DataFrame | None = None,
                  cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """New alert rows: cooldown per event, then one row per channel not yet alerted."""
    state = None if alerts is None else last_alerted(alerts)
    pairs = expand_channels(cooldown(anomalies, cfg, state), cfg.channels)
    if alerts is not None:
        pairs = drop_known(pairs, alerts)
    return alert_records(pairs, outcomes, cfg)
