"""Oracle text of the detectors: forest growth and walks, correlation, rotations, errors.

Trees are grown level by level and walked by recursion; principal components come
from Jacobi rotations, one recursion step each.
"""

from __future__ import annotations

from collections.abc import Sequence

from .sql import K, cte, forecast_cte, fused_cte, rules_cte

FEATURES = ("total_cost", "total_usage", "event_count", "hour_of_day", "day_of_week", "day_of_month", "month", "is_weekend",
            "is_business_hour", "hour_sin", "hour_cos", "dow_sin", "dow_cos")
#: What the reconstruction leaves out.
LINEAR = tuple(f for f in FEATURES if f != "event_count")
LEVELS, TREES, SAMPLE, SEED = 8, 100, 256, 42
COMPONENTS = max(2, len(LINEAR) // 3)
_EULER = 0.5772156649015329


def draw(*parts: str) -> str:
    text = " || ':' || ".join(parts)
    return f"(('0x' || substr(md5('{SEED}:' || {text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def path_of(n: str) -> str:
    return f"CASE WHEN {n} = 2 THEN 1.0 WHEN {n} > 2 THEN 2.0 * (ln({n} - 1.0) + {_EULER}) - 2.0 * ({n} - 1.0) / {n} ELSE 0.0 END"


def _each(names: Sequence[str], template: str) -> str:
    return "[" + ", ".join(template.format(c=c, i=i + 1) for i, c in enumerate(names)) + "]"


cte("calendar", """SELECT *, hour(bucket) AS hour_of_day, isodow(bucket) - 1 AS day_of_week, day(bucket) AS day_of_month, month(bucket) AS month,
  CASE WHEN isodow(bucket) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN isodow(bucket) < 6 AND hour(bucket) >= 9 AND hour(bucket) < 17 THEN 1 ELSE 0 END AS is_business_hour,
  sin(hour(bucket) * (2 * pi() / 24)) AS hour_sin, cos(hour(bucket) * (2 * pi() / 24)) AS hour_cos,
  sin((isodow(bucket) - 1) * (2 * pi() / 7)) AS dow_sin, cos((isodow(bucket) - 1) * (2 * pi() / 7)) AS dow_cos FROM hourly""", "hourly")

# -- isolation forest ----------------------------------------------------------------

cte("if_rows", f"""SELECT *, row_number() OVER () AS rid, account_id || '|' || service || '|' || region || '|' || CAST(bucket AS VARCHAR) AS k,
  {_each(FEATURES, 'CAST({c} AS DOUBLE)')} AS x FROM calendar""", "calendar")
cte("if_size", f"""SELECT n, size, per_tree, least(1.0, per_tree * {TREES}) AS pool, greatest(1, CAST(ceil(log2(greatest(size, 2))) AS INT)) AS depth
  FROM (SELECT *, least(CAST(1.0 AS DOUBLE), (1.5 * size + 64)::DOUBLE / n) AS per_tree
        FROM (SELECT count(*) AS n, least({SAMPLE}, count(*)) AS size FROM if_rows))""", "if_rows")
cte("if_members", f"""SELECT tree, x FROM (SELECT tree, x, u, size FROM (
    SELECT tree, x, size, {draw("'tree'", 'tree', 'k')} AS u, per_tree / pool AS rate
    FROM if_rows, if_size, (SELECT unnest(range({TREES})) AS tree) WHERE {draw("'row'", 'k')} < pool) WHERE u < rate)
  QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, x) <= size""", "if_rows", "if_size")
cte("if_level0", "SELECT tree, 1 AS node, x FROM if_members", "if_members")
for _d in range(LEVELS + 1):
    cte(f"if_split{_d}", f"""SELECT tree, node, n, f, CASE WHEN cut >= lo[f] AND cut < hi[f] THEN cut ELSE lo[f] END AS cut FROM (
      SELECT *, lo[f] + {draw("'cut'", 'tree', 'node')} * (hi[f] - lo[f]) AS cut FROM (
        SELECT *, CASE WHEN {_d} < depth AND n > 1 AND len(can) > 0 THEN can[1 + CAST(floor({draw("'feature'", 'tree', 'node')} * len(can)) AS INT)] END AS f
        FROM (SELECT *, list_filter(range(1, {len(FEATURES) + 1}), lambda i: hi[i] > lo[i]) AS can FROM (
          SELECT tree, node, count(*) AS n, {_each(FEATURES, 'min(x[{i}])')} AS lo, {_each(FEATURES, 'max(x[{i}])')} AS hi
          FROM if_level{_d} GROUP BY 1, 2)), (SELECT depth FROM if_size)))""", f"if_level{_d}", "if_size")
    cte(f"if_level{_d + 1}", f"""SELECT l.tree, 2 * l.node + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END AS node, x
      FROM if_level{_d} l JOIN if_split{_d} s ON l.tree = s.tree AND l.node = s.node WHERE f IS NOT NULL""", f"if_level{_d}", f"if_split{_d}")
cte("if_nodes", " UNION ALL ".join(
    f"SELECT tree, node, f, CASE WHEN f IS NULL THEN 0.0 ELSE cut END AS cut, CASE WHEN f IS NULL THEN {d} + {path_of('n')} ELSE 0.0 END AS path "
    f"FROM if_split{d}" for d in range(LEVELS + 1)), *[f"if_split{d}" for d in range(LEVELS + 1)])
cte("if_walk", f"""SELECT rid, tree, 1 AS node, x FROM if_rows, (SELECT unnest(range({TREES})) AS tree)
  UNION ALL SELECT w.rid, w.tree, 2 * w.node + CASE WHEN x[f] <= cut THEN 0 ELSE 1 END, x
  FROM if_walk w JOIN if_nodes n ON n.tree = w.tree AND n.node = w.node WHERE f IS NOT NULL""", "if_rows", "if_nodes")
cte("if_raw", f"""SELECT rid, pow(2.0, -(sum(path) / {TREES}) / any_value({path_of('size')})) AS raw
  FROM if_walk w JOIN if_nodes n ON n.tree = w.tree AND n.node = w.node, if_size WHERE f IS NULL GROUP BY rid""", "if_walk", "if_nodes", "if_size")
cte("if_scored", f"""SELECT {K}, bucket, CASE WHEN hi = lo THEN 0.5 ELSE greatest(0.0, least(1.0, (raw - lo) / (hi - lo))) END AS if_score,
  CASE WHEN raw > 0.5 THEN 1 ELSE 0 END AS if_anomaly
  FROM if_raw JOIN if_rows USING (rid), (SELECT min(raw) AS lo, max(raw) AS hi FROM if_raw)""", "if_raw", "if_rows")

# -- reconstruction error ------------------------------------------------------------

_D = len(LINEAR)
_CELLS = [(i, j) for i in range(1, _D + 1) for j in range(1, _D + 1)]


def _at(i: str, j: str) -> str:
    return f"[({i} - 1) * {_D} + {j}]"


def _columns(m: str) -> str:
    """The matrix times the rotation of columns p and q."""
    return f"""list_transform(range({_D * _D}), lambda e: CASE WHEN e % {_D} + 1 = p THEN c * {m}[e + 1] - s * {m}{_at('(e // %d + 1)' % _D, 'q')}
      WHEN e % {_D} + 1 = q THEN s * {m}{_at('(e // %d + 1)' % _D, 'p')} + c * {m}[e + 1] ELSE {m}[e + 1] END)"""


def _rows(m: str) -> str:
    """The transposed rotation of rows p and q times the matrix."""
    return f"""list_transform(range({_D * _D}), lambda e: CASE WHEN e // {_D} + 1 = p THEN c * {m}[e + 1] - s * {m}{_at('q', '(e %% %d + 1)' % _D)}
      WHEN e // {_D} + 1 = q THEN s * {m}{_at('p', '(e %% %d + 1)' % _D)} + c * {m}[e + 1] ELSE {m}[e + 1] END)"""


cte("re_rows", f"SELECT *, row_number() OVER () AS rid, {_each(LINEAR, 'CAST({c} AS DOUBLE)')} AS x FROM calendar", "calendar")
cte("re_scale", f"""SELECT {_each(LINEAR, 'avg(x[{i}])')} AS mean,
  {_each(LINEAR, 'CASE WHEN stddev_samp(x[{i}]) > 0 THEN stddev_samp(x[{i}]) ELSE 1.0 END')} AS std, count(*) AS n FROM re_rows""", "re_rows")
cte("re_z", f"SELECT rid, {K}, bucket, {_each(LINEAR, '(x[{i}] - mean[{i}]) / std[{i}]')} AS z FROM re_rows, re_scale", "re_rows", "re_scale")
cte("re_corr", f"SELECT [{', '.join(f'sum(z[{i}] * z[{j}]) / (count(*) - 1)' for i, j in _CELLS)}] AS a FROM re_z", "re_z")
cte("re_pairs", f"""SELECT row_number() OVER (ORDER BY p, q) - 1 AS k, p, q FROM (SELECT unnest(range(1, {_D + 1})) AS p), (SELECT unnest(range(1, {_D + 1})) AS q)
  WHERE p < q""")
# cyclic sweeps; ten settle matrices of this size far below rounding
cte("re_jacobi", f"""SELECT 0 AS step, a, list_transform(range({_D * _D}), lambda e: CASE WHEN e // {_D} = e % {_D} THEN 1.0 ELSE 0.0 END)::DOUBLE[] AS v FROM re_corr
  UNION ALL SELECT step + 1, {_rows('b')}, {_columns('v')} FROM (
    SELECT step, p, q, c, s, v, {_columns('a')} AS b FROM (
      SELECT step, a, v, p, q, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (
        SELECT step, a, v, p, q, CASE WHEN a{_at('p', 'q')} = 0 THEN 0.0 ELSE
          CASE WHEN theta < 0 THEN -1.0 ELSE 1.0 END / (abs(theta) + sqrt(theta * theta + 1)) END AS t FROM (
          SELECT step, a, v, p, q, (a{_at('q', 'q')} - a{_at('p', 'p')}) / nullif(2 * a{_at('p', 'q')}, 0) AS theta
          FROM re_jacobi JOIN re_pairs ON k = step % {_D * (_D - 1) // 2} WHERE step < {10 * _D * (_D - 1) // 2}))))""", "re_corr", "re_pairs")
cte("re_vectors", f"""SELECT rank, list_transform(w, lambda y: y * sgn) AS w FROM (
    SELECT rank, w, CASE WHEN list_max(w) >= -list_min(w) THEN 1.0 ELSE -1.0 END AS sgn FROM (
      SELECT row_number() OVER (ORDER BY a{_at('j', 'j')} DESC) - 1 AS rank, list_transform(range({_D}), lambda i: v[i * {_D} + j]) AS w
      FROM (SELECT a, v FROM re_jacobi ORDER BY step DESC LIMIT 1), (SELECT unnest(range(1, {_D + 1})) AS j))) WHERE rank < {COMPONENTS}""", "re_jacobi")
cte("re_model", f"""SELECT f.feature, mean[i] AS mean, std[i] AS std,
  {', '.join(f'(SELECT w FROM re_vectors WHERE rank = {r})[i] AS component_{r}' for r in range(COMPONENTS))}
  FROM (SELECT unnest([{', '.join(f"'{f}'" for f in LINEAR)}]) AS feature, unnest(range(1, {_D + 1})) AS i) f, re_scale""", "re_vectors", "re_scale")
cte("re_errors", f"""SELECT rid, {K}, bucket, list_sum(list_transform(range(1, {_D + 1}), lambda i: (z[i] - back[i]) * (z[i] - back[i]))) / {_D} AS mse FROM (
    SELECT rid, {K}, bucket, any_value(z) AS z, [{', '.join(f'sum(h * w[{i}])' for i in range(1, _D + 1))}] AS back FROM (
      SELECT r.*, w, list_sum(list_transform(range(1, {_D + 1}), lambda i: z[i] * w[i])) AS h FROM re_z r, re_vectors)
    GROUP BY rid, {K}, bucket)""", "re_z", "re_vectors")
cte("re_scored", f"""SELECT {K}, bucket, if_score, CASE WHEN if_score >= CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END AS if_anomaly FROM (
  SELECT {K}, bucket, greatest(0.0, least(1.0, (mse - lo) / (hi - lo))) AS if_score
  FROM re_errors, (SELECT quantile_cont(mse, 0.05) AS lo, quantile_cont(mse, 0.95) AS hi FROM re_errors))""", "re_errors")

# -- the ensemble with a detector ----------------------------------------------------

cte("det_base", f"SELECT h.*, if_score, if_anomaly FROM hourly h JOIN re_scored USING ({K}, bucket)", "hourly", "re_scored")
forecast_cte("det_forecast", "det_base", "profile")
rules_cte("det_ruled", "det_forecast")
cte("det_in", "SELECT *, least(abs(z_score), 10.0) / 10.0 AS ts_signal FROM det_ruled", "det_ruled")
fused_cte("det_scored", "det_in")
