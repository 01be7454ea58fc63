"""Quernstone: a Spark-native engine that prepares text corpora."""
