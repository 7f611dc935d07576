"""Siltstone: Spark-native analytics over file manifests and text corpora."""
