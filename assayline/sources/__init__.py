"""Scans, unions, sinks and the sample generator."""

from assayline.sources.delimited import REJECT, read_delimited, rejects, write_delimited, write_splits
from assayline.sources.names import ALIASES, canonical_names
from assayline.sources.summary import read_summary, write_summary
from assayline.sources.synthetic import synthetic_samples, synthesise
from assayline.sources.union import union_tagged

__all__ = [
    "ALIASES",
    "canonical_names",
    "REJECT",
    "read_delimited",
    "rejects",
    "read_summary",
    "synthesise",
    "synthetic_samples",
    "union_tagged",
    "write_delimited",
    "write_splits",
    "write_summary",
]
