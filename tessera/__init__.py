"""tessera: a Spark-native engine for service-operations analytics, retrieval and corpus preparation."""
