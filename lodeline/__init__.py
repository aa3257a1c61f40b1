"""A Spark-native automated analyst: one table in, explainable analytics out."""
