"""Spark-native data work around training and evaluating language agents."""
