"""Ledgerloom: a PySpark-native engine for long semi-structured filings and the relational data beside them."""

__version__ = "0.1.0"
