"""Spark-native string similarity, grammar compression and seaweed algebra."""
