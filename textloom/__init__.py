"""SQL analytics over text, SQLite and Parquet files on Spark."""

__version__ = "0.1.0"
