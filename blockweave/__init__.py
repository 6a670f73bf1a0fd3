"""Spark-native block-transform, image-sequence and corpus analytics."""
