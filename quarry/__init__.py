"""quarry: a Spark-first engine for indexing and searching collections of files by meaning."""

__version__ = "0.1.0"
