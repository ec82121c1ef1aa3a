"""Spark-native engine that turns business-document text into checked, queryable records."""
