"""strata: a PySpark-native engine for long-lived conversational memory."""

__version__ = "0.1.0"
