"""Operators for preparing language-model training data (queries in ``queries.py``)."""
