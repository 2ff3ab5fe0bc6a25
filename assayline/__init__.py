"""Spark-native profiling, preparation, modelling and scoring of measurement tables."""

from assayline.spec import SAMPLE_RANGES, SAMPLE_SPEC, TableSpec

__all__ = ["SAMPLE_RANGES", "SAMPLE_SPEC", "TableSpec"]
