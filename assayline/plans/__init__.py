"""Jobs composed of the operators: prepare, train, score."""

from assayline.plans.prepare import Preparation, fit_preparation
from assayline.plans.score import score_batch, score_by_rule, score_table
from assayline.plans.train import train_job, training_journal, training_summary

__all__ = [
    "Preparation",
    "fit_preparation",
    "score_batch",
    "score_by_rule",
    "score_table",
    "train_job",
    "training_journal",
    "training_summary",
]
