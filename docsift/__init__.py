"""docsift: a Spark-native engine for document diagnostics and corpus preparation."""
