"""Spark-native analytics over descriptor tables, identities and verification scores."""
