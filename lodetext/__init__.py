"""lodetext: text indexing, retrieval and training-data preparation as plain Spark DataFrame plans."""

__version__ = "0.1.0"
