"""loam: a PySpark engine for document corpora, their knowledge graphs and the analytics over both."""

__version__ = "0.1.0"
