"""Regressors, training, prediction and persistence on MLlib."""

from assayline.models.catalogue import MODELS, ModelConfig
from assayline.models.persistence import load_models, save_models
from assayline.models.prediction import predict, predict_with_spread
from assayline.models.regression import PenalisedRegression
from assayline.models.training import ModelSet, Trained, quick_train, train_all, train_one

__all__ = [
    "MODELS",
    "ModelConfig",
    "ModelSet",
    "PenalisedRegression",
    "Trained",
    "load_models",
    "predict",
    "predict_with_spread",
    "quick_train",
    "save_models",
    "train_all",
    "train_one",
]
