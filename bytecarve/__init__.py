"""bytecarve: recover files from raw bytes with Spark, as DataFrames."""

__version__ = "0.1.0"
