"""Classifiers and regressors over partitions, and what they need."""
