"""A Spark-native engine that reconciles line items without common keys."""

__version__ = "0.1.0"
