"""Operators for training data: one module for each problem, queries in ``catalog``."""
