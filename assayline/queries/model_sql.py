"""Models of all columns in plain SQL: standardised rows, penalised lines, and trees grown level by level.

Each constant is a list of common table expressions that follow one another:

``DATA``     rows ``data(key, y, split, fold, x)``, x being the list of the standardised model columns
``FRESH``    the unprepared rows as ``fresh(key, x)``, ``STREAMED`` with all their columns as ``streamed``
``linear``   ``fits(model, alpha, point, params, held, w, b)``, by elimination and coordinate descent; ``held`` is
             the fold left out, -1 for none
``tree``     leaves and split points of one regression tree over every column and every threshold
"""

from __future__ import annotations

from assayline.models import MODELS
from assayline.queries.samples import CLEANED, KEY, MEASURES, SPEC, columns, split_cte

KEYS = columns(*KEY)
WIDTH = len(SPEC.model_columns)
SWEEPS = 1500


def _row(prefix: str = "", fill: str = "") -> str:
    cells = [f"coalesce({prefix}{m}, {fill}{m})::DOUBLE" if fill else f"{prefix}{m}::DOUBLE" for m in MEASURES]
    return f"[{', '.join(cells)}, (CASE {prefix}wine_type WHEN 'red' THEN 0 ELSE 1 END)::DOUBLE]"


_SCALED = f"list_transform(range(1, {WIDTH + 1}), lambda i: (raw[i] - means[i]) / sds[i]) AS x"
DATA = f"""{CLEANED}, {split_cte("cleaned")},
wide AS MATERIALIZED (SELECT {KEYS}, quality AS y, split, fold, {_row()} AS raw FROM split),
scaler AS MATERIALIZED (SELECT list(mean ORDER BY i) AS means, list(sd ORDER BY i) AS sds FROM (
  SELECT i, avg(raw[i]) AS mean, stddev_pop(raw[i]) AS sd FROM wide, range(1, {WIDTH + 1}) t(i) WHERE split = 'train' GROUP BY i)),
data AS MATERIALIZED (SELECT {KEYS}, y, split, fold, {_SCALED} FROM wide, scaler)"""

FRESH = f"""unprepared AS (SELECT {columns(*(f"d.{k}" for k in KEY))}, {_row("d.", "m.")} AS raw FROM dirty d, medians m),
fresh AS MATERIALIZED (SELECT {KEYS}, {_SCALED} FROM unprepared, scaler)"""

# The unprepared rows whole, with x.
STREAMED = f"""arrived AS (SELECT d.*, {_row("d.", "m.")} AS raw FROM dirty d, medians m),
streamed AS (SELECT arrived.*, {_SCALED} FROM arrived, scaler)"""

GRID = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {a}::DOUBLE, {l1}::DOUBLE, {i}, '{params}')"
    for m, l1 in (("ridge", 0.0), ("lasso", 1.0), ("elastic_net", 0.5))
    for i, a in enumerate(MODELS[m].grid["alpha"])
    for params in [f'{{"alpha": {a}, "l1_share": 0.5}}' if m == "elastic_net" else f'{{"alpha": {a}}}']
) + ") t(model, alpha, l1, point, params))"


def _linear(models: tuple[str, ...]) -> str:
    """Solutions of the named models at every penalty, per fold left out and for all training rows."""
    d = WIDTH
    names = ", ".join(f"'{m}'" for m in models)
    return f"""{GRID},
sums AS MATERIALIZED (
  SELECT fold, i, j, sum(z[i] * z[j]) AS s FROM (SELECT fold, list_concat(x, [y::DOUBLE, 1.0::DOUBLE]) AS z FROM data WHERE split = 'train') q,
    range(1, {d + 3}) a(i), range(1, {d + 3}) b(j) GROUP BY ALL),
totals AS MATERIALIZED (SELECT held, i, j, sum(s) AS s FROM sums, (SELECT unnest([-1, 0, 1, 2]) AS held) h WHERE fold <> held GROUP BY ALL),
ones AS MATERIALIZED (SELECT held, i, s FROM totals WHERE j = {d + 2}),
covs AS MATERIALIZED (
  SELECT t.held, t.i, t.j, n.s AS n, t.s / n.s - (a.s / n.s) * (b.s / n.s) AS c FROM totals t
  JOIN ones a ON a.held = t.held AND a.i = t.i JOIN ones b ON b.held = t.held AND b.i = t.j JOIN ones n ON n.held = t.held AND n.i = {d + 2}
  WHERE t.i <= {d} AND t.j <= {d + 1}),
systems AS MATERIALIZED (
  SELECT g.held, g.n, g.g, b.b, m.mx, m.my FROM
    (SELECT held, any_value(n) AS n, list(r ORDER BY i) AS g FROM (SELECT held, i, any_value(n) AS n, list(c ORDER BY j) AS r FROM covs WHERE j <= {d} GROUP BY held, i) GROUP BY held) g
    JOIN (SELECT held, list(c ORDER BY i) AS b FROM covs WHERE j = {d + 1} GROUP BY held) b ON g.held = b.held
    JOIN (SELECT o.held, list(o.s / n.s ORDER BY o.i) FILTER (o.i <= {d}) AS mx, max(o.s / n.s) FILTER (o.i = {d + 1}) AS my
          FROM ones o JOIN ones n ON o.held = n.held AND n.i = {d + 2} GROUP BY o.held) m ON g.held = m.held),
eliminated AS (
  SELECT model, alpha, held, 0 AS k, list_transform(range(0, {d * (d + 1)}), lambda p:
    CASE WHEN p % {d + 1} = {d} THEN b[p // {d + 1} + 1]
    ELSE g[p // {d + 1} + 1][p % {d + 1} + 1] + CASE WHEN p // {d + 1} = p % {d + 1} THEN alpha / n ELSE 0 END END) AS m
  FROM grid, systems WHERE model = 'ridge' AND model IN ({names})
  UNION ALL
  SELECT model, alpha, held, k + 1, list_transform(range(0, {d * (d + 1)}), lambda p:
    CASE WHEN p // {d + 1} = k THEN m[p + 1] / m[k * {d + 2} + 1]
    ELSE m[p + 1] - m[(p // {d + 1}) * {d + 1} + k + 1] * m[k * {d + 1} + p % {d + 1} + 1] / m[k * {d + 2} + 1] END)
  FROM eliminated WHERE k < {d}),
descent AS (
  SELECT model, alpha, l1, held, 0 AS s, list_transform(range(0, {d}), lambda i: 0.0::DOUBLE) AS w FROM grid, systems WHERE model <> 'ridge' AND model IN ({names})
  UNION ALL
  SELECT model, alpha, l1, held, s + 1, list_transform(range(1, {d + 1}), lambda j: CASE WHEN j <> s % {d} + 1 THEN w[j] ELSE
      sign(rest) * greatest(abs(rest) - alpha * l1, 0) / (g[j][j] + alpha * (1 - l1)) END)
  FROM (SELECT q.*, y.g, y.b[s % {d} + 1] - list_inner_product(y.g[s % {d} + 1], w) + y.g[s % {d} + 1][s % {d} + 1] * w[s % {d} + 1] AS rest
        FROM descent q JOIN systems y ON q.held = y.held WHERE s < {d * SWEEPS})),
solved AS MATERIALIZED (
  SELECT model, alpha, held, list_transform(range(0, {d}), lambda i: m[i * {d + 1} + {d + 1}]) AS w FROM eliminated WHERE k = {d}
  UNION ALL SELECT model, alpha, held, w FROM descent WHERE s = {d * SWEEPS}),
fits AS MATERIALIZED (
  SELECT v.model, v.alpha, g.point, g.params, v.held, w, y.my - list_inner_product(w, y.mx) AS b
  FROM solved v JOIN systems y ON v.held = y.held JOIN grid g ON g.model = v.model AND g.alpha = v.alpha),
fold_errors AS (
  SELECT model, alpha, point, params, held, avg((y - b - list_inner_product(w, x)) ** 2) AS mse FROM fits JOIN data ON split = 'train' AND fold = held GROUP BY ALL),
cv AS MATERIALIZED (SELECT model, alpha, point, params, avg(mse) AS cv_mean, stddev_pop(mse) AS cv_std FROM fold_errors GROUP BY ALL),
best AS MATERIALIZED (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY model ORDER BY cv_mean, point) = 1)"""


METRICS = """metrics AS MATERIALIZED (SELECT model, split, count(*) AS n, avg((y - p) ** 2) AS mse, avg(abs(y - p)) AS mae,
  sqrt(avg((y - p) ** 2)) AS rmse, 1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM predicted GROUP BY ALL),
winner AS MATERIALIZED (SELECT model FROM metrics WHERE split = 'val' ORDER BY r2 DESC LIMIT 1)"""


def linear(models: tuple[str, ...] = ("ridge", "lasso", "elastic_net")) -> str:
    """``DATA`` and all solutions of the named models."""
    return f"WITH RECURSIVE {DATA}, {_linear(models)}"


def tuned(models: tuple[str, ...] = ("ridge", "lasso", "elastic_net")) -> str:
    """``linear``, the best point of each model and its predictions and metrics."""
    return f"""{linear(models)},
predicted AS MATERIALIZED (SELECT model, data.*, b + list_inner_product(w, x) AS p FROM data, (SELECT f.* FROM fits f JOIN best USING (model, alpha) WHERE f.held = -1) f),
{METRICS}"""


def tree(name: str, rows: str, target: str, depth: int = 3) -> str:
    """One tree grown on ``rows(r, x, target)``: ``{name}_split{level}(node, i, cut, n, gain)``, ``{name}_leaf(node, value)``.

    Thresholds lie half-way between neighbouring values of a column among all rows; equal gains go to the first
    column and threshold. Children of node k are 2k (up to the threshold) and 2k + 1.
    """
    steps = [f"""{name}_long AS MATERIALIZED (SELECT r, i, x[i] AS v, {target} AS t FROM {rows}, range(1, {WIDTH + 1}) u(i)),
{name}_cut AS MATERIALIZED (SELECT i, v, (v + lead(v) OVER (PARTITION BY i ORDER BY v)) / 2 AS cut FROM (SELECT DISTINCT i, v FROM {name}_long)),
{name}_at0 AS (SELECT r, x, {target} AS t, 1 AS node FROM {rows})"""]
    for k in range(depth):
        steps.append(f"""{name}_sum{k} AS (
  SELECT i, v, node, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY node, i) AS n, sum(s) OVER (PARTITION BY node, i) AS s
  FROM (SELECT node, i, v, count(*) AS n, sum(l.t) AS s FROM {name}_long l JOIN {name}_at{k} a ON l.r = a.r GROUP BY ALL) WINDOW w AS (PARTITION BY node, i ORDER BY v)),
{name}_split{k} AS MATERIALIZED (
  SELECT node, i, cut, n, gain FROM (SELECT q.node, q.i, c.cut, q.v, q.n, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain
    FROM {name}_sum{k} q JOIN {name}_cut c ON q.i = c.i AND q.v = c.v WHERE nl < n)
  WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY node ORDER BY gain DESC, i, v) = 1),
{name}_at{k + 1} AS MATERIALIZED (SELECT r, x, t, 2 * a.node + CASE WHEN x[i] > cut THEN 1 ELSE 0 END AS node FROM {name}_at{k} a LEFT JOIN {name}_split{k} s ON a.node = s.node)""")
    steps.append(f"{name}_leaf AS MATERIALIZED (SELECT node, avg(t) AS value FROM {name}_at{depth} GROUP BY node)")
    return ",\n".join(steps)


def walk(out: str, name: str, rows: str, kept: str, value: str = "value", depth: int = 3) -> str:
    """``out(kept, value)``: ``rows`` with ``x`` sent down the tree, keeping the given columns."""
    steps = [f"{out}_on0 AS (SELECT {kept}, x, 1 AS node FROM {rows})"]
    for k in range(depth):
        steps.append(f"{out}_on{k + 1} AS (SELECT {kept}, x, 2 * a.node + CASE WHEN x[i] > cut THEN 1 ELSE 0 END AS node FROM {out}_on{k} a LEFT JOIN {name}_split{k} s ON a.node = s.node)")
    steps.append(f"{out} AS MATERIALIZED (SELECT {kept}, x, l.value AS {value} FROM {out}_on{depth} a LEFT JOIN {name}_leaf l ON a.node = l.node)")
    return ",\n".join(steps)


def importances(name: str, depth: int = 3) -> str:
    """``importances(feature, importance)``: the splits' gains in squares by column, as shares of their sum."""
    gains = " UNION ALL ".join(f"SELECT i, gain FROM {name}_split{k}" for k in range(depth))
    listed = ", ".join(f"({i}, '{c}')" for i, c in enumerate(SPEC.model_columns, 1))
    return f"""gains AS (SELECT i, sum(gain) AS gain FROM ({gains}) GROUP BY i),
importances AS (SELECT feature, coalesce(gain / sum(gain) OVER (), 0) AS importance FROM (VALUES {listed}) c(i, feature) LEFT JOIN gains g ON c.i = g.i)"""


TRAIN = "train AS MATERIALIZED (SELECT row_number() OVER () AS r, x, y::DOUBLE AS y FROM data WHERE split = 'train')"
