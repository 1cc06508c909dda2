"""textmill: labelled text corpora on Spark, from raw rows to scored rows."""

__version__ = "0.1.0"
