"""Spark-native analytics for annotated genomic variants."""
