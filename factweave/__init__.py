"""factweave: a Spark-native engine for evidence-backed fact graphs and training-data pipelines."""
