"""claimloom: Spark-first processing of quoted claims, their sources and their texts."""

__version__ = "0.1.0"
