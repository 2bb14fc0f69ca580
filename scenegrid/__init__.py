"""Spark-native analytics over figure scenes: operators are DataFrame in, DataFrame out."""
