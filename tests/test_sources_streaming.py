from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.plans.score import score_by_rule
from assayline.queries.registry import rounded
from assayline.session import shared_dir
from assayline.sources import (
    canonical_names,
    REJECT,
    read_delimited,
    rejects,
    synthetic_samples,
    union_tagged,
    write_delimited,
    write_splits,
)
from assayline.sources.synthetic import EXPONENTIALS, NORMALS
from assayline.spec import SAMPLE_CATEGORIES, SAMPLE_RANGES, SAMPLE_SPEC
from assayline.streaming import read_stream, score_stream

# Three literal samples.
ROWS = """fixed_acidity,volatile_acidity,citric_acid,residual_sugar,chlorides,free_sulfur_dioxide,total_sulfur_dioxide,density,ph,sulphates,alcohol,wine_type
7.4,0.7,0.0,1.9,0.076,11.0,34.0,0.9978,3.51,0.56,9.4,red
8.1,0.88,0.0,2.6,0.098,25.0,67.0,0.9968,3.20,0.68,9.8,red
7.2,0.23,0.32,8.5,0.058,47.0,186.0,0.9956,3.19,0.40,NaN,white
"""


def test_scan_goes_by_name_and_canonicalises(spark, tmp_path):
    (tmp_path / "s.csv").write_text(ROWS)
    df = read_delimited(spark, str(tmp_path / "s.csv"), SAMPLE_SPEC.schema())
    assert df.columns[:2] == ["fixed acidity", "volatile acidity"] and "pH" in df.columns
    assert dict(df.dtypes)["alcohol"] == "double" and dict(df.dtypes)["wine_type"] == "string"
    rows = df.collect()
    assert [r["alcohol"] for r in rows] == [9.4, 9.8, None] and rows[0]["pH"] == 3.51


def test_scan_with_another_column_order_and_separator(spark, tmp_path):
    (tmp_path / "s.csv").write_text("wine_type;alcohol;note\nred;9.5;x\n;;\n")
    rows = read_delimited(spark, str(tmp_path / "s.csv"), SAMPLE_SPEC.schema(), sep=";").collect()
    assert [tuple(r) for r in rows] == [("red", 9.5, "x"), (None, None, None)]


def test_files_with_differing_headers_raise(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "a.csv").write_text("alcohol,chlorides\n1.0,2.0\n")
    (folder / "b.csv").write_text("chlorides,alcohol\n2.0,1.0\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(folder), SAMPLE_SPEC.schema()).collect()


def test_inferred_types(spark, tmp_path):
    (tmp_path / "s.csv").write_text(ROWS)
    assert dict(read_delimited(spark, str(tmp_path / "s.csv")).dtypes)["alcohol"] == "double"


def test_union_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    got = sorted((r.x, r.y, r.kind) for r in union_tagged({"a": a, "b": b}, "kind").collect())
    assert got == [(1, 2, "a"), (3, None, "b")]


def test_split_sink_writes_every_row_once(spark, tmp_path):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 6, "train").otherwise("test"))
    write_splits(df, str(tmp_path / "o"))
    assert spark.read.csv(str(tmp_path / "o" / "split=train"), header=True).count() == 6
    write_delimited(df, str(tmp_path / "p"))
    with pytest.raises(Exception, match="(?i)already exists"):
        write_delimited(df, str(tmp_path / "p"))


def test_generator_moments_and_reproducibility(spark):
    frame = synthetic_samples(spark, 4000, seed=42).toPandas()
    assert frame["alcohol"].mean() == pytest.approx(10.5, abs=0.1)
    assert frame["alcohol"].std() == pytest.approx(1.5, abs=0.1)
    assert frame["residual sugar"].mean() == pytest.approx(3.0, abs=0.2)
    assert set(frame["wine_type"]) == {"red", "white"}
    assert frame["quality"].between(3, 9).all()
    assert np.corrcoef(frame["alcohol"], frame["quality"])[0, 1] > 0.4
    assert np.abs(np.corrcoef(frame["alcohol"], frame["density"])[0, 1]) < 0.05
    again = synthetic_samples(spark, 4000, seed=42).repartition(3).toPandas().sort_values("sample_id")
    assert (again["alcohol"].to_numpy() == frame.sort_values("sample_id")["alcohol"].to_numpy()).all()


def test_names_are_compared_exactly(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "ph double, citric_acid double")
    assert canonical_names(df).columns == ["pH", "citric acid"]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = synthetic_samples(spark, 300).drop("quality").withColumn(
        "wine_type", F.when(F.col("sample_id") % 7 == 0, " RED").otherwise(F.col("wine_type"))
    )

    def run():
        stream = read_stream(spark, source, rows.schema)
        score_stream(
            stream, lambda d: score_by_rule(d, offset=-8.0, details=True), sink, state, SAMPLE_RANGES, SAMPLE_CATEGORIES
        ).awaitTermination()

    rows.where("sample_id < 200").write.mode("append").parquet(source)
    run()
    rows.where("sample_id >= 200").write.mode("append").parquet(source)
    run()
    out = spark.read.parquet(sink)
    assert out.count() == 300 and out.where("NOT valid").count() > 0
    assert out.where("NOT valid AND predicted_quality IS NOT NULL").count() == 0
    batch = score_by_rule(rows.withColumn("wine_type", F.lower(F.trim("wine_type"))), offset=-8.0)
    joined = out.where("valid").select("sample_id", F.col("predicted_quality").alias("p")).join(batch, "sample_id")
    assert joined.where("NOT p <=> predicted_quality").count() == 0
    assert set(r[0] for r in out.select("wine_type").distinct().collect()) == {"red", "white"}


def test_trained_stream_needs_no_aggregate(spark, synthetic, tmp_path):
    from assayline.models import predict_with_spread
    from assayline.models.catalogue import ModelConfig
    from assayline.models.training import quick_train
    from assayline.plans.prepare import assemble, fit_preparation
    from assayline.spec import TableSpec
    from pyspark.ml.regression import RandomForestRegressor

    spec = TableSpec(("alcohol", "pH"), "wine_type", "quality", ("sample_id",))
    prepared, preparation = fit_preparation(synthetic, spec)
    forest = ModelConfig(lambda seed: RandomForestRegressor(numTrees=3, maxDepth=2, seed=seed))
    trained = quick_train(assemble(prepared, spec.model_columns), "quality", "forest", models={"forest": forest})
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    synthetic.write.parquet(source)
    score_stream(
        read_stream(spark, source, synthetic.schema),
        lambda d: predict_with_spread(preparation.transform(d), trained).drop("features"),
        sink,
        str(tmp_path / "state"),
        {"alcohol": (5.0, 20.0)},
    ).awaitTermination()
    assert spark.read.parquet(sink).count() == synthetic.count()


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_malformed_lines_are_kept_dropped_or_refused(spark, tmp_path):
    (tmp_path / "s.csv").write_text("alcohol,wine_type\n9.5,red\nabc,white\n,red\n1x0,red\n")
    path, schema = str(tmp_path / "s.csv"), SAMPLE_SPEC.schema()
    kept = read_delimited(spark, path, schema, malformed="keep")
    assert [(r["alcohol"], r[REJECT]) for r in kept.collect()] == [(9.5, None), (None, "abc,white"), (None, None), (None, "1x0,red")]
    assert [r[0] for r in rejects(kept).collect()] == ["abc,white", "1x0,red"]
    assert rejects(kept).count() == 2
    assert read_delimited(spark, path, schema, malformed="drop").collect()[0]["alcohol"] == 9.5
    assert len(read_delimited(spark, path, schema, malformed="drop").collect()) == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        read_delimited(spark, path, schema).collect()
    with pytest.raises(ValueError):
        read_delimited(spark, path, schema, malformed="guess")


def test_methods_that_draw_samples_are_small_enough_to_be_compiled(spark, capsys):
    # The JVM interprets methods beyond 8,000 bytes for ever.
    rounded(synthetic_samples(spark, 10), 5, *NORMALS, *EXPONENTIALS).explain("codegen")
    sizes = [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8_000


def test_rounding_is_that_of_spark(spark):
    tenths = F.expr("(id - 200000) / 100000D")
    cells = [tenths, tenths / 2, tenths + 0.000005, tenths * 1e9, tenths * 1e-9, F.expr("sin(id) * 12"), F.expr("pow(10, id % 40 - 20) * 1.000005")]
    odd = spark.sql("SELECT explode(array(double('NaN'), double('-inf'), -0.0D, -1e-9D, CAST(NULL AS DOUBLE))) AS x")
    rows = spark.range(400_001).select(F.explode(F.array(*cells)).alias("x")).union(odd)
    for digits in (0, 4, 5):
        text = F.col("x").cast("string")
        both = rounded(rows.withColumn("told", F.round("x", digits)), digits, "x").withColumn("text", text)
        assert both.where(~text.eqNullSafe(F.col("told").cast("string"))).isEmpty()
