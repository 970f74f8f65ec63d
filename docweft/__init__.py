"""docweft: a PySpark-native analytics engine for linked technical documents."""

__version__ = "0.1.0"
