"""Unsupervised detectors: isolation forest and reconstruction error.

Both produce ``if_score`` in [0, 1] and ``if_anomaly``. Fitting reads the
training frame in Spark; the fitted model is small and bounded (trees of at
most 2 * 256 nodes; one matrix of features x components), so it travels to the
executors inside the plan, in batch and in streams alike.

Nothing about a fit is left to a generator's state or to the order of rows.
Whether a row belongs to a tree, which feature a node cuts and where are read
off MD5 digests of the row's key, the tree and the node; components are those of
the correlation matrix with a fixed sign. So the same rows give the same model
on any cluster, and the fit can be said in SQL.

A fitted model is one nested record (``MODEL_SCHEMA``): tree nodes or components,
what fills and scales the features, score range. ``sources.models`` keeps records
in a versioned table and reads one back without a Spark job.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from ..config import ForestConfig, ReconstructionConfig
from ..functions.exprs import staged
from ..functions.quantiles import exact_quantiles

# Columns never used as features: identity, forecast and detector outputs.
EXCLUDED = frozenset({
    "bucket", "account_id", "service", "region", "forecast_mean", "forecast_std", "residual", "abs_residual",
    "z_score", "abs_z_score", "if_score", "if_anomaly",
})
EXCLUDED_PREFIXES = ("is_outside_ci_", "ci_lower_", "ci_upper_")


def feature_columns(df: DataFrame, explicit: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """The explicit list (absent names dropped) or every eligible numeric column."""
    if explicit:
        return [c for c in explicit if c in df.columns]
    banned = EXCLUDED | set(exclude)
    cols = [
        f.name for f in df.schema
        if isinstance(f.dataType, NumericType) and f.name not in banned and not f.name.startswith(EXCLUDED_PREFIXES)
    ]
    if not cols:
        raise ValueError("no numeric feature columns")
    return cols


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with every feature present; NaN counts as missing."""
    as_double = {c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in features}
    return df.withColumns(as_double).dropna(subset=list(features))


def feature_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, median`` over the non-missing values of each column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.nullif(F.col(c).cast("double"), F.lit(float("nan"))).alias("v"))
        for c in features])).alias("r")).select("r.*")
    return exact_quantiles(long, "v", {"median": 0.5}, by=["feature"])


def _small_dict(rows: DataFrame, key: str, value: str) -> dict:
    """A per-feature or per-statistic table as a dict (one entry per column)."""
    return {r[key]: r[value] for r in rows.collect()}


# -- isolation forest ----------------------------------------------------------------

#: One row per model. ``fill`` holds medians or means, ``scale`` standard deviations.
MODEL_SCHEMA = """model_version string, kind string, train_rows bigint, features array<string>, fill array<double>, scale array<double>,
  components array<array<double>>, sample_size int,
  trees array<struct<tree: int, node: int, feature: int, cut: double, path: double>>, lo double, hi double, cut double"""
#: A node's children are 2 * node (at most the cut) and 2 * node + 1; the root is 1, a leaf has feature -1.
TREE_SCHEMA = "tree int, node int, feature int, cut double, path double"
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits, which a double holds


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = n[big]
    out[big] = 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m
    return out


def draw(*parts) -> float:
    """Uniform in [0, 1), a function of the parts' text."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:_DIGITS], 16) / 16.0 ** _DIGITS


def draw_column(*parts: Column) -> Column:
    """:func:`draw` as a column."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, _DIGITS), 16, 10).cast("double") / F.lit(16.0 ** _DIGITS)


def grow_tree(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple[int, int, float, float]]:
    """(node, feature, cut, path) of one isolation tree; its draws depend on nothing but seed, tree and node."""
    nodes = []
    todo = [(1, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        splittable = np.flatnonzero(hi > lo) if len(rows) > 1 else []
        if depth >= limit or len(splittable) == 0:
            nodes.append((node, -1, 0.0, depth + float(average_path([len(rows)])[0])))
            continue
        f = int(splittable[int(draw(seed, "feature", tree, node) * len(splittable))])
        cut = float(lo[f] + draw(seed, "cut", tree, node) * (hi[f] - lo[f]))
        if not lo[f] <= cut < hi[f]:
            cut = float(lo[f])
        nodes.append((node, f, cut, 0.0))
        below = x[rows, f] <= cut
        todo += [(2 * node, rows[below], depth + 1), (2 * node + 1, rows[~below], depth + 1)]
    return nodes


@dataclass
class IsolationForest:
    """Fitted forest. ``nodes`` is the node table, ``medians`` the fill values."""

    features: list[str]
    medians: dict[str, float]
    nodes: pd.DataFrame
    sample_size: int
    score_lo: float = 0.0
    score_hi: float = 0.0
    cut: float = 0.5
    train_rows: int = 0

    def record(self, version: str | None = None) -> dict:
        """The model as one nested record."""
        return {
            "model_version": version, "kind": "forest", "train_rows": self.train_rows, "features": self.features,
            "fill": [self.medians.get(c, 0.0) for c in self.features], "scale": [], "components": [], "sample_size": self.sample_size,
            "trees": self.nodes[["tree", "node", "feature", "cut", "path"]].sort_values(["tree", "node"]).to_dict("records"),
            "lo": self.score_lo, "hi": self.score_hi, "cut": self.cut}

    @classmethod
    def from_record(cls, r: dict) -> IsolationForest:
        nodes = pd.DataFrame(r["trees"], columns=["tree", "node", "feature", "cut", "path"])
        return cls(r["features"], dict(zip(r["features"], r["fill"])), nodes, r["sample_size"], r["lo"], r["hi"], r["cut"], r["train_rows"])

    def _heaps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, cut, path) with a row per tree and a cell per node number."""
        rank = np.unique(self.nodes["tree"], return_inverse=True)[1]
        node = self.nodes["node"].to_numpy()
        shape = (int(rank.max()) + 1, int(node.max()) + 1)
        out = np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape)
        for heap, name in zip(out, ("feature", "cut", "path")):
            heap[rank, node] = self.nodes[name]
        return out

    def raw_score(self) -> Column:
        """2 ** (-mean path / expected path) per row; only features reach Python."""
        feature, cut, path = self._heaps()
        norm = float(average_path([self.sample_size])[0]) or 1.0

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            trees = np.arange(len(feature))
            for cols in batches:
                cols = (cols,) if isinstance(cols, pd.Series) else cols  # one feature arrives bare
                x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
                total = np.zeros(len(x))
                for a in range(0, len(x), 4096):
                    part = x[a:a + 4096]
                    # all rows walk all trees, level by level
                    row, tree = (i.ravel() for i in np.meshgrid(np.arange(len(part)), trees, indexing="ij"))
                    at = np.ones(len(row), np.int64)
                    while len(row):
                        f = feature[tree, at]
                        leaf = f < 0
                        total[a:a + len(part)] += np.bincount(row[leaf], path[tree[leaf], at[leaf]], len(part))
                        row, tree, at, f = row[~leaf], tree[~leaf], at[~leaf], f[~leaf]
                        at = 2 * at + (part[row, f] > cut[tree, at])
                yield pd.Series(np.power(2.0, -(total / len(feature)) / norm))

        udf = F.pandas_udf(score, "double", F.PandasUDFType.SCALAR_ITER)
        return udf(*[F.col(f"_f_{c}") for c in self.features])

    def _prepared(self, df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.withColumns({
            f"_f_{c}": F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(self.medians.get(c, 0.0)))
            if c in have else F.lit(self.medians.get(c, 0.0))
            for c in self.features})

    def scored(self, df: DataFrame) -> DataFrame:
        return self._prepared(df).withColumn("_raw", self.raw_score()).drop(*[f"_f_{c}" for c in self.features])

    def transform(self, df: DataFrame) -> DataFrame:
        width = self.score_hi - self.score_lo
        scaled = F.lit(0.5) if width == 0 else F.least(F.greatest(
            (F.col("_raw") - F.lit(self.score_lo)) / F.lit(width), F.lit(0.0)), F.lit(1.0))
        out = self.scored(df).withColumns({
            "if_score": scaled, "if_anomaly": (F.col("_raw") > F.lit(self.cut)).cast("int")})
        return out.drop("_raw")


def fit_forest(df: DataFrame, cfg: ForestConfig = ForestConfig(), features: Sequence[str] = (),
               row_key: Sequence[str] = ("account_id", "service", "region", "bucket")) -> IsolationForest:
    """Fit on complete rows; each tree sees ``max_samples`` of them, or all if there are fewer.

    A tree's rows are those with the smallest draws for it: no global shuffle or
    sort. Rows that no tree can want are dropped by one draw first, so only about
    ``1.5 * trees * max_samples`` rows ever move, whatever the table size.
    """
    cols = feature_columns(df, features)
    train = complete_rows(df, cols).select(*[c for c in row_key if c in df.columns and c not in cols], *cols).persist()
    try:
        return _fit_forest(df, train, cols, cfg, row_key)
    finally:
        train.unpersist()


def _fit_forest(df: DataFrame, train: DataFrame, cols: list[str], cfg: ForestConfig, row_key: Sequence[str]) -> IsolationForest:
    n = train.count()
    if n < cfg.min_train_rows:
        raise ValueError(f"training set has {n} complete rows, need at least {cfg.min_train_rows}")
    size = min(cfg.max_samples, n)
    per_tree = min(1.0, (1.5 * size + 64) / n)
    pool = min(1.0, per_tree * cfg.trees)
    named = [F.col(c) for c in row_key if c in train.columns] or [F.col(c) for c in cols]
    key = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in named])
    seed = cfg.seed
    members = (
        train.withColumn("_k", key).filter(draw_column(F.lit(seed), F.lit("row"), F.col("_k")) < F.lit(pool))
        .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1))))
        .withColumn("_u", draw_column(F.lit(seed), F.lit("tree"), F.col("tree"), F.col("_k")))
        .filter(F.col("_u") < F.lit(per_tree / pool)))
    limit = max(1, int(np.ceil(np.log2(max(size, 2)))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values(["_u", *cols])[cols].to_numpy(dtype=float)[:size]
        out = pd.DataFrame(grow_tree(x, seed, tree, limit), columns=["node", "feature", "cut", "path"])
        out.insert(0, "tree", tree)
        return out

    nodes = members.select("tree", "_u", *cols).groupBy("tree").applyInPandas(build, TREE_SCHEMA).toPandas()
    medians = _small_dict(feature_medians(df, cols), "feature", "median")
    model = IsolationForest(cols, medians, nodes, size, train_rows=n)
    raw = model.scored(train).select("_raw")
    lo, hi = raw.agg(F.min("_raw"), F.max("_raw")).first()
    model.score_lo, model.score_hi = float(lo), float(hi)
    if cfg.contamination != "auto":
        model.cut = float(exact_quantiles(raw, "_raw", {"c": 1.0 - float(cfg.contamination)}).first()["c"])
    return model


# -- reconstruction error ------------------------------------------------------------


@dataclass
class Reconstruction:
    """Linear autoencoder: standardise, project, rebuild, compare."""

    features: list[str]
    means: list[float]
    stds: list[float]
    components: list[list[float]]
    error_lo: float = 0.0
    error_hi: float = 1.0
    threshold: float = 0.6
    train_rows: int = 0

    def record(self, version: str | None = None) -> dict:
        """The model as one nested record."""
        return {
            "model_version": version, "kind": "reconstruction", "train_rows": self.train_rows, "features": self.features, "fill": self.means,
            "scale": self.stds, "components": self.components, "sample_size": None, "trees": [], "lo": self.error_lo, "hi": self.error_hi,
            "cut": self.threshold}

    @classmethod
    def from_record(cls, r: dict) -> Reconstruction:
        return cls(r["features"], r["fill"], r["scale"], r["components"], r["lo"], r["hi"], r["cut"], r["train_rows"])

    def error(self, have: set[str]) -> tuple[dict[str, Column], dict[str, Column], Column]:
        """Standardised inputs, projections and the mean squared rebuild error."""
        z = {}
        for c, m, s in zip(self.features, self.means, self.stds):
            x = F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) if c in have else F.lit(None).cast("double")
            # a missing value takes the training mean, i.e. zero
            z[f"_z_{c}"] = F.coalesce((x - F.lit(m)) / F.lit(s), F.lit(0.0))
        h = {}
        for j in range(len(self.components)):
            h[f"_h_{j}"] = sum(
                (F.lit(w) * F.col(f"_z_{c}") for w, c in zip(self.components[j], self.features)), F.lit(0.0))
        squares = F.lit(0.0)
        for i, c in enumerate(self.features):
            rebuilt = sum((F.lit(self.components[j][i]) * F.col(f"_h_{j}") for j in range(len(self.components))), F.lit(0.0))
            squares = squares + F.pow(F.col(f"_z_{c}") - rebuilt, F.lit(2.0))
        return z, h, squares / F.lit(float(len(self.features)))

    def with_error(self, df: DataFrame) -> DataFrame:
        z, h, mse = self.error(set(df.columns))
        out = staged(staged(df, df.columns, z), [*df.columns, *z], h)
        return staged(out, df.columns, {"_mse": mse})

    def transform(self, df: DataFrame) -> DataFrame:
        scaled = (F.col("_mse") - F.lit(self.error_lo)) / F.lit(self.error_hi - self.error_lo)
        out = self.with_error(df).withColumn("if_score", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(1.0)))
        return out.withColumn("if_anomaly", (F.col("if_score") >= F.lit(self.threshold)).cast("int")).drop("_mse")


def principal_components(corr: np.ndarray, k: int) -> list[list[float]]:
    """The first k eigenvectors, each signed so that its largest entry is positive."""
    _, vectors = np.linalg.eigh(corr)
    out = []
    for v in vectors.T[::-1][:k]:
        out.append((v * np.sign(v[np.argmax(np.abs(v))])).tolist())
    return out


def _product_sums(train: DataFrame, cols: list[str], means: list[float], stds: list[float]) -> np.ndarray:
    """Sum over rows of the outer product of the standardised features.

    Each task multiplies its batches as matrices; d x d sums of a task are added
    by Spark, and d x d numbers come back.
    """
    d = len(cols)
    m, s = np.array(means), np.array(stds)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            z = (np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) - m) / s
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    sums = train.select(*cols).mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(d * d)
    for r in sums:
        out[r["cell"]] = r["value"]
    return out.reshape(d, d)


def fit_reconstruction(df: DataFrame, cfg: ReconstructionConfig = ReconstructionConfig(),
                       features: Sequence[str] = (), exclude: Sequence[str] = ("event_count",)) -> Reconstruction:
    """Standardise, then the principal components of the correlation matrix."""
    cols = feature_columns(df, features, exclude)
    train = complete_rows(df, cols).select(*cols).persist()
    try:
        return _fit_reconstruction(train, cols, cfg)
    finally:
        train.unpersist()


def _fit_reconstruction(train: DataFrame, cols: list[str], cfg: ReconstructionConfig) -> Reconstruction:
    about = train.agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in cols]).alias("mean"), F.array(*[F.stddev_samp(c) for c in cols]).alias("std")).first()
    n = about["n"]
    if n < cfg.min_train_rows:
        raise ValueError(f"training set has {n} complete rows, need at least {cfg.min_train_rows}")
    means, stds = list(about["mean"]), [v if v and v > 0 else 1.0 for v in about["std"]]
    corr = _product_sums(train, cols, means, stds) / max(n - 1, 1)
    components = principal_components(corr, min(cfg.width(len(cols)), len(cols)))
    model = Reconstruction(cols, means, stds, components, threshold=cfg.threshold, train_rows=n)
    q = exact_quantiles(model.with_error(train), "_mse", {"lo": cfg.pct_lo, "hi": cfg.pct_hi}).first()
    model.error_lo, model.error_hi = float(q["lo"]), float(q["hi"])
    if model.error_hi <= model.error_lo:
        model.error_hi = model.error_lo + 1e-9
    return model


KINDS = {"forest": IsolationForest, "reconstruction": Reconstruction}
