"""A Spark-native engine for FASTQ sequencing reads."""

__version__ = "0.1.0"
