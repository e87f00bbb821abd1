"""Spark-native urban form analytics: zonal parameters, labels and agreement as DataFrame plans."""
