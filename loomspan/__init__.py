"""loomspan: a Spark-native library for retrieval, dataset and evaluation analytics."""
