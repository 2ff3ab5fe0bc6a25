"""Profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import cut
from assayline.operators import profile
from assayline.operators.outliers import iqr_fences, outlier_report, treat_outliers
from assayline.operators.relations import correlation_matrix, crosstab, top_correlated, trend_line
from assayline.queries.registry import query, rounded, table
from assayline.queries.samples import (
    DIRTY,
    KEY,
    MEASURES,
    SAMPLES,
    columns,
    dirty_samples,
    samples,
)

NUMERIC = (*MEASURES, "quality")


def _union(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(names))


_TYPES = {"quality": "int", "wine_type": "string"}
_INFO = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {i} AS position, '{_TYPES.get(c, "double")}' AS dtype, count({c}) AS non_null,
    count(*) AS rows, 13 AS columns FROM dirty"""
    for i, c in enumerate([*MEASURES, "wine_type", "quality"])
)


@query("table_info", f"WITH {DIRTY} {_INFO}")
def table_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_info(dirty_samples(spark, sf_dir).drop(*KEY))


@query(
    "head_rows",
    f"WITH {SAMPLES} SELECT * FROM samples ORDER BY {columns(*KEY)}, density LIMIT 5",
)
def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.head_rows(samples(spark, sf_dir), [*KEY, "density"], 5)


_DESCRIBE = _union(
    """SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
    round(stddev_samp({c}), 6) AS std, round(min({c})::DOUBLE, 6) AS min,
    round(quantile_cont({c}, 0.25)::DOUBLE, 6) AS q25, round(quantile_cont({c}, 0.5)::DOUBLE, 6) AS q50,
    round(quantile_cont({c}, 0.75)::DOUBLE, 6) AS q75, round(max({c})::DOUBLE, 6) AS max FROM dirty""",
    NUMERIC,
)


@query("describe_numeric", f"WITH {DIRTY} {_DESCRIBE}")
def describe_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = profile.describe_numeric(dirty_samples(spark, sf_dir).drop(*KEY))
    return rounded(described, 6, "mean", "std", "min", "q25", "q50", "q75", "max")


@query("distinct_values", f"WITH {SAMPLES} SELECT DISTINCT quality FROM samples ORDER BY quality")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_values(samples(spark, sf_dir), "quality")


@query("value_counts", f"WITH {SAMPLES} SELECT quality, count(*) AS count FROM samples GROUP BY quality")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(samples(spark, sf_dir), "quality")


@query(
    "value_counts_by_frequency",
    "SELECT event_type, count(*) AS count FROM events GROUP BY event_type ORDER BY count DESC, event_type",
)
def value_counts_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.value_counts(table(spark, sf_dir, "events"), "event_type", by_frequency=True)


@query(
    "category_share",
    f"""WITH {SAMPLES} SELECT wine_type, count(*) AS count,
    round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percentage FROM samples GROUP BY wine_type""",
)
def category_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.category_share(samples(spark, sf_dir), "wine_type"), 4, "percentage")


@query(
    "equality_share",
    """SELECT count(*) FILTER (WHERE lang = 'en') AS count,
    round(100.0 * count(*) FILTER (WHERE lang = 'en') / count(*), 4) AS percentage FROM documents""",
)
def equality_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.equality_share(table(spark, sf_dir, "documents"), "lang", "en"), 4, "percentage")


@query(
    "range_mean",
    f"WITH {SAMPLES} "
    + _union(
        """SELECT '{c}' AS feature, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
        round(avg({c}), 6) AS mean FROM samples""",
        ("quality", "alcohol"),
    ),
)
def range_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.range_mean(samples(spark, sf_dir), ["quality", "alcohol"]), 6, "mean")


_QUARTILES = _union(
    "SELECT '{c}' AS feature, quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM samples",
    MEASURES,
)
_FENCES = f"""quartiles AS ({_QUARTILES}),
fences AS (SELECT feature, q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM quartiles)"""


@query(
    "iqr_fences",
    f"""WITH {SAMPLES}, {_FENCES} SELECT feature, round(q1, 6) AS q1, round(q3, 6) AS q3,
    round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound FROM fences""",
)
def iqr_fences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fences = iqr_fences(samples(spark, sf_dir), MEASURES)
    return rounded(fences, 6, "q1", "q3", "lower_bound", "upper_bound")


_EVENT_FENCES = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)"""


@query(
    "outlier_report",
    f"""WITH {_EVENT_FENCES},
    e AS (SELECT 'value' AS feature, count(*) FILTER (WHERE value < lo OR value > hi) AS outliers,
      round(100.0 * count(*) FILTER (WHERE value < lo OR value > hi) / count(*), 4) AS percentage,
      round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound FROM events, f),
    dq AS (SELECT quantile_cont(n_chars, 0.25)::DOUBLE AS q1, quantile_cont(n_chars, 0.75)::DOUBLE AS q3 FROM documents),
    df AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM dq)
    SELECT * FROM e UNION ALL
    SELECT 'n_chars', count(*) FILTER (WHERE n_chars < lo OR n_chars > hi),
      round(100.0 * count(*) FILTER (WHERE n_chars < lo OR n_chars > hi) / count(*), 4),
      round(any_value(lo), 6), round(any_value(hi), 6) FROM documents, df""",
)
def outlier_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = outlier_report(table(spark, sf_dir, "events"), ["value"])
    documents = outlier_report(table(spark, sf_dir, "documents"), ["n_chars"])
    return rounded(events.unionByName(documents), 6, "lower_bound", "upper_bound").withColumn(
        "percentage", F.round("percentage", 4)
    )


@query(
    "outlier_rows",
    f"""WITH {_EVENT_FENCES} SELECT event_id, event_type, value FROM events, f WHERE value < lo OR value > hi""",
)
def outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return treat_outliers(events, ["value"], "select").select("event_id", "event_type", "value")


@query(
    "outlier_drop",
    f"WITH {_EVENT_FENCES} SELECT event_id, event_type, value FROM events, f WHERE value BETWEEN lo AND hi",
)
def outlier_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return treat_outliers(events, ["value"], "drop").select("event_id", "event_type", "value")


@query(
    "outlier_clip",
    f"""WITH {_EVENT_FENCES} SELECT event_id, round(least(greatest(value, lo), hi), 6) AS value
    FROM events, f""",
)
def outlier_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rounded(treat_outliers(events, ["value"], "clip").select("event_id", "value"), 6, "value")


_CLASSES = range(3, 10)


@query(
    "crosstab",
    f"WITH {SAMPLES} SELECT wine_type, "
    + ", ".join(f'count(*) FILTER (WHERE quality = {q}) AS "{q}"' for q in _CLASSES)
    + " FROM samples GROUP BY wine_type",
)
def crosstab_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab(samples(spark, sf_dir), "wine_type", "quality", list(_CLASSES))


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, round(corr({a}, {b}), 5) AS corr FROM dirty"
    for a in NUMERIC
    for b in NUMERIC
)


@query("correlation_matrix", f"WITH {DIRTY} {_CORR}")
def correlation_matrix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(correlation_matrix(dirty_samples(spark, sf_dir), NUMERIC), 5, "corr")


_TOP = f"""pairs AS ({_union("SELECT '{c}' AS feature, corr({c}, quality) AS corr FROM dirty", MEASURES)}),
top AS (SELECT CAST(row_number() OVER (ORDER BY round(abs(corr), 9) DESC, feature) AS INTEGER) AS rank, feature, corr FROM pairs)"""


@query(
    "top_correlated",
    f"""WITH {DIRTY}, {_TOP} SELECT rank, feature, round(corr, 5) AS corr, round(abs(corr), 5) AS abs_corr
    FROM top WHERE rank <= 6""",
)
def top_correlated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_correlated(dirty_samples(spark, sf_dir), MEASURES, "quality", 6)
    return rounded(top, 5, "corr", "abs_corr")


@query(
    "histogram",
    f"""WITH {SAMPLES}, r AS (SELECT min(alcohol) AS lo, max(alcohol) AS hi FROM samples),
    b AS (SELECT least(floor((alcohol - lo) / (hi - lo) * 20)::INTEGER + 1, 20) AS bin FROM samples, r),
    c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
    SELECT s.bin::INTEGER AS bin, round(lo + (s.bin - 1) * ((hi - lo) / 20), 6) AS lower,
      round(lo + s.bin * ((hi - lo) / 20), 6) AS upper, coalesce(n, 0) AS count
    FROM (SELECT unnest(range(1, 21)) AS bin) s CROSS JOIN r LEFT JOIN c ON c.bin = s.bin""",
)
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.histogram(samples(spark, sf_dir), "alcohol", 20), 6, "lower", "upper")


@query(
    "box_stats",
    f"""WITH {SAMPLES}, binned AS (
      SELECT CASE WHEN quality <= 0 THEN NULL WHEN quality <= 4 THEN 'Low' WHEN quality <= 6 THEN 'Medium'
        WHEN quality <= 10 THEN 'High' END AS band, density AS v FROM samples),
    q AS (SELECT band, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
      quantile_cont(v, 0.75) AS q3 FROM binned GROUP BY band)
    SELECT band, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
      round(any_value(q3), 6) AS q3,
      round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
    FROM binned JOIN q USING (band) GROUP BY band""",
)
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    banded = samples(spark, sf_dir).withColumn(
        "band", cut(F.col("quality"), [0, 4, 6, 10], ["Low", "Medium", "High"])
    )
    boxes = profile.box_stats(banded, "density", ["band"])
    return rounded(boxes, 6, "q1", "median", "q3", "whisker_low", "whisker_high")


@query(
    "trend_line",
    f"WITH {DIRTY} "
    + _union(
        """SELECT '{c}' AS feature, round(regr_slope(quality, {c}), 4) AS slope,
        round(regr_intercept(quality, {c}), 4) AS intercept FROM dirty""",
        ("alcohol", "volatile_acidity", "citric_acid"),
    ),
)
def trend_line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = trend_line(dirty_samples(spark, sf_dir), ["alcohol", "volatile_acidity", "citric_acid"], "quality")
    return rounded(lines, 4, "slope", "intercept")


@query("scatter_points", f"WITH {SAMPLES} SELECT alcohol AS x, quality AS y FROM samples")
def scatter_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.scatter_points(samples(spark, sf_dir), "alcohol", "quality")


@query("select_numeric", f"WITH {SAMPLES} SELECT {columns(*MEASURES)} FROM samples")
def select_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.select_numeric(samples(spark, sf_dir), exclude=[*KEY, "quality"])


_HOLES = " + ".join(f"(count(*) - count({m}))" for m in MEASURES)
EDA_SQL = f"""WITH {DIRTY}, {_TOP}, plain AS (SELECT * EXCLUDE ({columns(*KEY)}) FROM dirty)
SELECT (SELECT count(*) FROM plain) AS n_rows, 13 AS n_columns,
  '{",".join(MEASURES)},wine_type' AS features, 'quality' AS target,
  (SELECT min(quality) FROM plain) AS target_min, (SELECT max(quality) FROM plain) AS target_max,
  (SELECT {_HOLES} FROM plain) AS missing_values,
  (SELECT count(*) FROM plain) - (SELECT count(*) FROM (SELECT DISTINCT * FROM plain)) AS duplicates,
  (SELECT string_agg(feature, ',' ORDER BY rank) FROM top WHERE rank <= 5) AS top_features"""


@query("eda_summary", EDA_SQL)
def eda_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.eda_summary(dirty_samples(spark, sf_dir).drop(*KEY), "quality", "wine_type")
    return summary.withColumn("top_features", F.array_join(F.transform("top_features", lambda f: f["feature"]), ","))
