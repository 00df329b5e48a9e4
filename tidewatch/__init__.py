"""Operations analytics on PySpark: validation, entity metrics, features, scoring, insights, alerts."""

__version__ = "0.1.0"
