"""Feature engineering, encoding, scaling, splitting, preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import cut, guarded_ratio, normalise_category, title
from assayline.operators.features import (
    align_schema,
    drop_columns,
    fit_labels,
    fit_scaler,
    scale,
)
from assayline.operators.split import fold_of, split_report, stratified_split
from assayline.plans.prepare import Preparation, fit_preparation
from assayline.queries.registry import query, rounded, table
from assayline.queries.samples import (
    CLEANED,
    KEY,
    MEASURES,
    SAMPLES,
    SPEC,
    columns,
    dirty_samples,
    key_text,
    samples,
    split_cte,
)
from assayline.session import fresh_path

_KEYS = columns(*KEY)


@query(
    "bin_target",
    f"""WITH {SAMPLES} SELECT {_KEYS}, quality, CASE WHEN quality < 0 THEN NULL WHEN quality <= 4 THEN 'low'
    WHEN quality <= 6 THEN 'medium' WHEN quality <= 10 THEN 'high' END AS quality_category FROM samples""",
)
def bin_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = cut(F.col("quality"), [0, 4, 6, 10], ["low", "medium", "high"], include_lowest=True)
    return samples(spark, sf_dir).select(*KEY, "quality", label.alias("quality_category"))


@query(
    "bin_strength",
    f"""WITH {SAMPLES} SELECT {_KEYS}, alcohol, CASE WHEN alcohol < 0 THEN NULL WHEN alcohol <= 10 THEN 'low'
    WHEN alcohol <= 12 THEN 'medium' WHEN alcohol <= 20 THEN 'high' END AS alcohol_strength FROM samples""",
)
def bin_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = cut(F.col("alcohol"), [0, 10, 12, 20], ["low", "medium", "high"], include_lowest=True)
    return samples(spark, sf_dir).select(*KEY, "alcohol", label.alias("alcohol_strength"))


@query(
    "ratio_guarded",
    f"WITH {SAMPLES} SELECT {_KEYS}, round(fixed_acidity / (volatile_acidity + 0.001), 6) AS acidity_ratio FROM samples",
)
def ratio_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = guarded_ratio(F.col("fixed_acidity"), F.col("volatile_acidity"))
    return rounded(samples(spark, sf_dir).select(*KEY, ratio.alias("acidity_ratio")), 6, "acidity_ratio")


@query(
    "ratio_sulfur",
    f"""WITH {SAMPLES} SELECT {_KEYS},
    round(free_sulfur_dioxide / (total_sulfur_dioxide + 0.001), 6) AS sulfur_ratio FROM samples""",
)
def ratio_sulfur(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio = guarded_ratio(F.col("free_sulfur_dioxide"), F.col("total_sulfur_dioxide"))
    return rounded(samples(spark, sf_dir).select(*KEY, ratio.alias("sulfur_ratio")), 6, "sulfur_ratio")


@query("drop_columns", f"WITH {SAMPLES} SELECT * EXCLUDE (quality, density) FROM samples")
def drop_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_columns(samples(spark, sf_dir), ["quality", "density"])


@query(
    "align_schema",
    f"""WITH {SAMPLES} SELECT {", ".join("CAST(0.0 AS DOUBLE) AS density" if m == "density" else m for m in MEASURES)},
    wine_type FROM samples""",
)
def align_schema_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and target are extra, density is missing."""
    return align_schema(samples(spark, sf_dir).drop("density"), SPEC.model_columns)


@query(
    "label_encode",
    """WITH kinds AS (SELECT DISTINCT p_type AS label FROM part)
    SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM kinds""",
)
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_labels(table(spark, sf_dir, "part"), "p_type").table


@query(
    "label_encode_many",
    """WITH kinds AS (SELECT DISTINCT o_orderkey::VARCHAR AS label FROM orders)
    SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM kinds""",
)
def label_encode_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary as large as its table."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("label"))
    return fit_labels(orders, "label").table


@query(
    "encode_unseen",
    """WITH kinds AS (SELECT DISTINCT event_type AS label FROM events WHERE event_type <> 'purchase'),
    codes AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS code FROM kinds)
    SELECT event_id, coalesce(code, 0) AS event_type FROM events LEFT JOIN codes ON label = event_type""",
)
def encode_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    labels = fit_labels(events.where("event_type <> 'purchase'"), "event_type")
    return labels.encode(events, "event_type")


_MOMENTS = ", ".join(f"avg({m}) AS {m}_mean, stddev_pop({m}) AS {m}_sd" for m in MEASURES)
_SCALED = ", ".join(
    f"round((s.{m} - {m}_mean) / CASE WHEN {m}_sd = 0 THEN 1 ELSE {m}_sd END, 4) AS {m}" for m in MEASURES
)


@query(
    "standard_scale",
    f"""WITH {SAMPLES}, {split_cte()}, moments AS (SELECT {_MOMENTS} FROM split WHERE split = 'train')
    SELECT {_KEYS}, split, {_SCALED} FROM split s CROSS JOIN moments""",
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stratified_split(samples(spark, sf_dir), "quality", KEY)
    scaler = fit_scaler(split.where("split = 'train'"), MEASURES)
    return rounded(scale(split, scaler).select(*KEY, "split", *MEASURES), 4, *MEASURES)


@query(
    "normalise_text",
    """SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) AS category,
      upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS title FROM events""",
)
def normalise_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shouted = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" "))
    return table(spark, sf_dir, "events").select(
        "event_id", normalise_category(shouted).alias("category"), title(F.col("event_type")).alias("title")
    )


@query("stratified_split", f"WITH {SAMPLES}, {split_cte()} SELECT {_KEYS}, quality, split FROM split")
def stratified_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(samples(spark, sf_dir), "quality", KEY).select(*KEY, "quality", "split")


@query(
    "stratified_split_events",
    f"""WITH ranked AS (
      SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || {key_text('event_id')})) AS rn,
        count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_id, event_type, CASE WHEN 10 * (rn - 1) < 6 * n THEN 'train' WHEN 10 * (rn - 1) < 8 * n THEN 'val'
      ELSE 'test' END AS split FROM ranked""",
)
def stratified_split_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return stratified_split(events, "event_type", ["event_id"])


@query(
    "split_report",
    f"""WITH {SAMPLES}, {split_cte()}
    SELECT split, quality, count(*) AS count, sum(count(*)) OVER (PARTITION BY split)::BIGINT AS split_rows,
      round(100.0 * sum(count(*)) OVER (PARTITION BY split) / sum(count(*)) OVER (), 4) AS split_percentage
    FROM split GROUP BY split, quality""",
)
def split_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = stratified_split(samples(spark, sf_dir), "quality", KEY)
    return rounded(split_report(split, "quality"), 4, "split_percentage")


@query("kfold_assign", f"WITH {SAMPLES}, {split_cte()} SELECT {_KEYS}, fold FROM split")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select(*KEY, fold_of(KEY, 3).alias("fold"))


_ENCODED = f"""{CLEANED}, {split_cte("cleaned")},
coded AS (SELECT * REPLACE (CASE WHEN wine_type = 'white' THEN 1 ELSE 0 END AS wine_type) FROM split),
moments AS (SELECT {_MOMENTS}, avg(wine_type) AS wine_type_mean, stddev_pop(wine_type) AS wine_type_sd
  FROM coded WHERE split = 'train')"""
_SCALED_ALL = f"{_SCALED}, round((s.wine_type - wine_type_mean) / wine_type_sd, 4) AS wine_type"


@query(
    "prepare_fit",
    f"""WITH {_ENCODED} SELECT {_KEYS}, quality, split, fold, {_SCALED_ALL} FROM coded s CROSS JOIN moments""",
)
def prepare_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared, _ = fit_preparation(dirty_samples(spark, sf_dir), SPEC)
    return rounded(prepared, 4, *SPEC.model_columns)


_NEW_ROWS = f"""fresh AS (
  SELECT {_KEYS}, {", ".join(f"coalesce(d.{m}, m.{m}) AS {m}" for m in MEASURES if m != "sulphates")},
    0.0 AS sulphates, CASE WHEN wine_type = 'white' THEN 1 ELSE 0 END AS wine_type
  FROM dirty d CROSS JOIN medians m)"""


@query(
    "processor_roundtrip",
    f"WITH {_ENCODED}, {_NEW_ROWS} SELECT {_SCALED_ALL} FROM fresh s CROSS JOIN moments",
)
def processor_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, save, load, apply to rows with missing cells and without one column."""
    rows = dirty_samples(spark, sf_dir)
    _, preparation = fit_preparation(rows, SPEC)
    path = fresh_path(spark, "preparation")
    preparation.save(spark, path)
    loaded = Preparation.load(spark, path)
    return rounded(loaded.transform_columns(rows.drop("sulphates")), 4, *SPEC.model_columns)
