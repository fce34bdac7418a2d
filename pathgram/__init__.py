"""Latent-variable path modelling and data screening on Spark DataFrames."""

from pathgram.spec import Effect, FitSettings, ModelError, ModelSpec

__all__ = ["Effect", "FitSettings", "ModelError", "ModelSpec"]
