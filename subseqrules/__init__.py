"""Batch jobs that discover and use dependency rules between subsequences of time series."""
