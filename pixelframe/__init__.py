"""Spatial feature engineering, statistics and models over gridded covariates and points, on Spark."""
