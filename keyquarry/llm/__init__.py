"""Operators for training-data corpora: one module per operator, their queries in ``queries``."""
