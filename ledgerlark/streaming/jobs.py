"""Structured Streaming jobs: normalise, roll up, score, cool down, publish.

Every job takes a streaming frame and a checkpoint location below the shared
folder; state lives in the state store, results in files, so a restarted
query continues where it stopped.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..config import KEYS, AlertConfig, BaselineConfig, ResidualConfig, RuleConfig, ScoringConfig, SeverityConfig
from ..operators.baseline import residuals
from ..operators.rules import sudden_jump, threshold_breach
from ..operators.scoring import add_severity, fuse, ts_signal
from ..functions.exprs import flag
from ..sources import messages as msg, normalize as norm

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State backend needed by the keyed processors."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def read_parquet_stream(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """File stream with the schema of the files already there."""
    glob = f"{path}/{pattern}" if pattern else path
    reader = spark.readStream.schema(spark.read.parquet(glob).schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_available(query_writer, checkpoint: str) -> StreamingQuery:
    """Process everything available, in as many micro-batches as needed, and stop."""
    q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


# -- normalise with dead letters ----------------------------------------------------


def normalize_stream(messages: DataFrame, accepted_path: str, dead_letter_path: str, stream: str = "billing-events"):
    """Writer that sends good messages to one table and rejects to the dead-letter store.

    Both outputs of a batch go to a folder named by the batch id, so a replayed
    batch replaces its own files instead of adding copies.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        out = norm.normalize(batch).persist()
        try:
            norm.accepted(out).write.mode("overwrite").parquet(f"{accepted_path}/batch={batch_id}")
            norm.rejected(out, F.current_timestamp(), stream).write.mode("overwrite").option(
                "ignoreNullFields", "false").json(f"{dead_letter_path}/batch={batch_id}")
        finally:
            out.unpersist()

    return messages.writeStream.foreachBatch(sink)


def dedup_stream(events: DataFrame, delay: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """First copy of each event id within the watermark delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])


def rollup_stream(events: DataFrame, grain: str = "1 minute", delay: str = "10 minutes", ts: str = "timestamp",
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """Windowed rollup in append mode: a bucket is emitted once it is complete.

    Rows later than the watermark delay are dropped.
    """
    return (
        events.withWatermark(ts, delay)
        .groupBy(F.window(ts, grain).alias("_w"), *keys)
        .agg(
            F.round(F.sum("cost_amount"), 6).alias("total_cost"),
            F.round(F.sum("usage_amount"), 6).alias("total_usage"),
            F.count(F.lit(1)).alias("event_count"))
        .select(F.col("_w.start").alias("bucket"), *keys, "total_cost", "total_usage", "event_count")
    )


# -- keyed scoring ---------------------------------------------------------------------

HISTORY_COLUMNS = ("ewma", "jump_mean", "sustained_seen", "sustained_passing")


@dataclass(frozen=True)
class StateConfig:
    """Bounds of the keyed processors."""

    #: State of a series that gets no row for so long is dropped; the series then starts anew. None keeps it.
    #: The clock is processing time, so the stream needs a processing-time trigger: under ``availableNow`` Spark
    #: goes on running empty batches for it and never ends.
    idle_seconds: int | None = None
    #: Rows of a series in one micro-batch that are held in memory; more go through the state store.
    row_limit: int = 200_000
    #: Rows that went through the store come back by time segments of this length.
    segment_seconds: int = 86_400

    @property
    def ttl(self) -> int | None:
        return None if self.idle_seconds is None else self.idle_seconds * 1000

    @property
    def time_mode(self) -> str:
        return "none" if self.idle_seconds is None else "processingTime"


class OrderedRows:
    """The rows a key gets in a micro-batch, as frames in ascending order.

    Rows arrive in pieces and in no order. Up to a limit they are sorted in
    memory. A larger backlog is put into the state store piece by piece, each cut
    by time segment, and taken out again one segment after the other, so memory
    holds the limit, or the rows of one segment if these are more.
    """

    def __init__(self, handle: StatefulProcessorHandle, cfg: StateConfig, micros: Callable[[pd.DataFrame], np.ndarray], order: Sequence[str]):
        self.cfg, self.micros, self.order = cfg, micros, list(order)
        self.store = handle.getMapState("backlog", "segment long, piece int", "rows binary")

    def _spill(self, held: list[pd.DataFrame], pieces: dict[int, list[int]], piece: int) -> None:
        pdf = pd.concat(held, ignore_index=True)
        segment = self.micros(pdf) // (self.cfg.segment_seconds * 1_000_000)
        for s, part in pdf.groupby(segment):
            self.store.updateValue((int(s), piece), (pickle.dumps(part, protocol=5),))
            pieces.setdefault(int(s), []).append(piece)

    def sorted(self, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        pieces: dict[int, list[int]] = {}
        n = piece = 0
        for pdf in rows:
            held.append(pdf)
            n += len(pdf)
            if n > self.cfg.row_limit:
                self._spill(held, pieces, piece)
                held, n, piece = [], 0, piece + 1
        if held and pieces:
            self._spill(held, pieces, piece)
            held = []
        if held:
            yield pd.concat(held, ignore_index=True).sort_values(self.order, ignore_index=True)
        for segment in sorted(pieces):
            parts = []
            for i in pieces[segment]:
                parts.append(pickle.loads(self.store.getValue((segment, i))[0]))
                self.store.removeKey((segment, i))
            yield pd.concat(parts, ignore_index=True).sort_values(self.order, ignore_index=True)


class HistoryProcessor(StatefulProcessor):
    """Adds what scoring needs from a series' past to each arriving bucket.

    State per series: the last costs (as many as the longest rule looks back),
    the running EWMA and the rows since its last known cost. A NULL cost adds
    nothing to the mean while its memory fades, as in ``baseline.ewma``, and
    counts as a row that did not grow, as in ``rules.apply_rules``. Rows of one
    batch are taken in bucket order.
    """

    def __init__(self, alpha: float, rules: RuleConfig, columns: Sequence[str], cfg: StateConfig = StateConfig()):
        self.alpha, self.rules, self.columns, self.cfg = alpha, rules, list(columns), cfg
        self.keep = max(60, rules.jump_lookback, rules.sustained_window)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", "ewma double, gap int, costs array<double>", self.cfg.ttl)
        self.rows = OrderedRows(handle, self.cfg, lambda p: p["bucket"].to_numpy("datetime64[us]").astype(np.int64), ["bucket"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        ewma, gap, costs = (stored[0], stored[1], list(stored[2])) if stored else (None, 0, [])
        for pdf in self.rows.sorted(rows):
            out = []
            for value in pdf[self.rules.target].astype(float).tolist():
                x = None if value != value else value
                ewma, gap = self._mean(ewma, gap + 1, x)
                out.append((ewma, *self._past(costs, x)))
                costs.append(x)
                if len(costs) > 4 * self.keep:
                    del costs[:-self.keep]
            extra = pd.DataFrame(out, columns=list(HISTORY_COLUMNS))
            yield pd.concat([pdf[self.columns], extra], axis=1)
        self.state.update((ewma, gap, costs[-self.keep:]))

    def _mean(self, ewma: float | None, gap: int, x: float | None) -> tuple[float | None, int]:
        if x is None:
            return ewma, gap
        if ewma is None:
            return x, 0
        old = (1.0 - self.alpha) ** gap
        fade = old / (old + self.alpha)
        return fade * ewma + (1.0 - fade) * x, 0

    def _past(self, costs: list[float | None], x: float | None) -> tuple[float | None, int, int]:
        n, growth = self.rules.sustained_window, self.rules.sustained_min_growth
        known = [c for c in costs[-self.rules.jump_lookback:] if c is not None]
        tail = [*costs[max(len(costs) - n, 0):], x]
        grew = [a is not None and b is not None and ((b > 0) if a == 0 else (b - a) / abs(a) >= growth) for a, b in zip(tail, tail[1:])]
        return (float(np.mean(known)) if known else None), sum(c is not None for c in tail), int(sum(grew))

    def close(self) -> None:
        pass


def score_stream(buckets: DataFrame, profile: DataFrame, rules: RuleConfig = RuleConfig(),
                 scoring: ScoringConfig = ScoringConfig(), severity: SeverityConfig = SeverityConfig(),
                 baseline: BaselineConfig = BaselineConfig(), keys: Sequence[str] = KEYS,
                 detector: Callable[[DataFrame], DataFrame] | None = None, state: StateConfig = StateConfig()) -> DataFrame:
    """Score a stream of buckets; same columns and values as the batch scorer.

    Only the order-dependent history runs in the keyed processor; everything
    else is the same column expressions as in batch. ``detector`` adds
    ``if_score`` and ``if_anomaly``, such as ``transform`` of a stored model
    (``sources.models.load``): the version found when the stream starts is the
    one it scores with. Its calendar features must be among the buckets' columns.
    """
    from statistics import NormalDist

    schema = StructType([f for f in buckets.schema])
    for name, kind in zip(HISTORY_COLUMNS, ("double", "double", "integer", "integer")):
        schema = schema.add(name, kind)
    df = buckets.groupBy(*keys).transformWithStateInPandas(
        HistoryProcessor(baseline.alpha, rules, buckets.columns, state), schema, "append", state.time_mode)
    slots = profile.select("hour_of_day", "day_of_week", F.col("mean").alias("_sm"), F.col("std").alias("_ss"))
    df = df.withColumns({"hour_of_day": F.hour("bucket"), "day_of_week": F.weekday("bucket")})
    df = df.join(F.broadcast(slots), ["hour_of_day", "day_of_week"], "left")
    sw = baseline.seasonal_weight
    df = df.withColumns({
        "forecast_mean": F.lit(sw) * F.col("_sm") + F.lit(1.0 - sw) * F.col("ewma"),
        "forecast_std": F.greatest(F.col("_ss") * F.lit(sw + (1.0 - sw) * baseline.alpha), F.lit(baseline.min_std)),
    })
    for level in baseline.levels:
        half = F.lit(NormalDist().inv_cdf((1.0 + level) / 2.0)) * F.col("forecast_std")
        pct = round(level * 100)
        df = df.withColumns({
            f"ci_lower_{pct}": F.when(F.col("forecast_mean").isNotNull(), F.greatest(F.col("forecast_mean") - half, F.lit(0.0))),
            f"ci_upper_{pct}": F.col("forecast_mean") + half})
    levels = tuple(round(level * 100) for level in baseline.levels)
    df = residuals(df, ResidualConfig(rules.target, levels, scoring.z_cap))
    if scoring.enable_if and detector is not None:
        df = detector(df)
    else:
        df = df.withColumns({"if_score": F.lit(None).cast("double"), "if_anomaly": F.lit(0)})
    x, n = F.col(rules.target).cast("double"), rules.sustained_window
    t_fired, t_score, _ = threshold_breach(x, rules.budget_limit)
    j_fired, j_score, _ = sudden_jump(x, F.col("jump_mean"), rules.jump_pct)
    enough = F.col("sustained_seen") >= n + 1
    df = df.withColumns({
        "ts_signal": ts_signal(F.col("abs_z_score"), scoring.z_cap),
        "threshold_fired": t_fired, "threshold_score": t_score,
        "jump_fired": j_fired, "jump_score": j_score,
        "sustained_fired": flag(enough & (F.col("sustained_passing") == n)),
        "sustained_score": F.when(enough, F.col("sustained_passing") / F.lit(float(n))).otherwise(F.lit(0.0)) if n else F.lit(0.0),
    })
    df = df.withColumn(
        "rule_score",
        F.lit(rules.weight_threshold) * F.col("threshold_score") + F.lit(rules.weight_jump) * F.col("jump_score")
        + F.lit(rules.weight_sustained) * F.col("sustained_score"))
    return add_severity(fuse(df, scoring), severity).drop("_sm", "_ss", "ewma")


# -- alert cooldown ---------------------------------------------------------------------


class CooldownProcessor(StatefulProcessor):
    """State per series: time of its last alert, in microseconds."""

    def __init__(self, seconds: int, columns: Sequence[str], cfg: StateConfig = StateConfig()):
        self.gap, self.columns, self.cfg = seconds * 1_000_000, list(columns), cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at long", self.cfg.ttl)
        self.rows = OrderedRows(handle, self.cfg, lambda p: p["at_micros"].to_numpy(np.int64), ["at_micros", "anomaly_id"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.state.get()
        last = stored[0] if stored else None
        for pdf in self.rows.sorted(rows):
            suppressed = []
            for t in pdf["at_micros"]:
                cooling = last is not None and t - last < self.gap
                suppressed.append(bool(cooling))
                if not cooling:
                    last = int(t)
            yield pdf[self.columns].assign(suppressed=suppressed)
        if last is not None:
            self.state.update((last,))

    def close(self) -> None:
        pass


def cooldown_stream(anomalies: DataFrame, cfg: AlertConfig = AlertConfig(), keys: Sequence[str] = KEYS,
                    state: StateConfig = StateConfig()) -> DataFrame:
    """Adds ``suppressed``. The state must outlive the cooldown, so an idle time below it is refused."""
    if state.idle_seconds is not None and state.idle_seconds < cfg.cooldown_seconds:
        raise ValueError("idle_seconds must not be below the cooldown")
    columns = anomalies.columns
    schema = StructType([f for f in anomalies.schema]).add("suppressed", "boolean")
    timed = anomalies.withColumn("at_micros", F.unix_micros("detected_at"))
    return timed.groupBy(*keys).transformWithStateInPandas(
        CooldownProcessor(cfg.cooldown_seconds, columns, state), schema, "append", state.time_mode)


# -- publishing a scored batch ------------------------------------------------------------


def publish_scored(scored: DataFrame, root: str, detected_at: Callable[[], object] = F.current_timestamp, keep: int = 5):
    """Writer that upserts anomalies, emits their messages and records metrics.

    The anomaly table is kept by day (``day_table``): a batch reads and writes
    the days its anomalies fall on. Its version is named by the batch id, so a
    replayed batch finds it committed and does not apply it twice. The counts are
    observed while the batch is written; no job counts rows.
    """
    from ..sources import day_table, tables

    spark = scored.sparkSession
    table_root = f"{root}/anomalies"

    def sink(batch: DataFrame, batch_id: int) -> None:
        tag = f"v{batch_id:012d}"
        seen, persisted = Observation(), Observation()
        observed = batch.observe(
            seen, F.count(F.lit(1)).alias("rows_scored"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies_detected"))
        fresh = tables.new_anomalies(observed, detected_at()).persist()
        try:
            day_table.merge(spark, table_root, tag, fresh, "bucket", tables.upsert_anomalies, keep)
            days = [r["day"] for r in fresh.select(day_table.day_of(F.col("bucket")).alias("day")).distinct().collect()]
            known = tables.list_versions(spark, table_root)
            current = day_table.read(spark, table_root, tag if tag in known else known[-1], days)
            keys = fresh.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(tables.ANOMALY_KEY)])
            same = F.lit(True)
            for i, k in enumerate(tables.ANOMALY_KEY):
                same = same & current[k].eqNullSafe(keys[f"_k{i}"])
            saved = current.join(keys, same, "left_semi").observe(persisted, F.count(F.lit(1)).alias("anomalies_persisted"))
            msg.anomaly_messages(saved).write.mode("overwrite").json(f"{root}/messages/batch={batch_id}")
            done = persisted.get["anomalies_persisted"]
            row = (batch_id, seen.get["rows_scored"], seen.get["anomalies_detected"], done, done)
            spark.createDataFrame([row], "batch_id long, rows_scored long, anomalies_detected long, anomalies_persisted long, events_emitted long").withColumn(
                "batch_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{root}/metrics/batch={batch_id}")
        finally:
            fresh.unpersist()

    return scored.writeStream.foreachBatch(sink)
