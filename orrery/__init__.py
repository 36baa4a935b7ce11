"""orrery: a PySpark-native analytics engine over key-value, collection, graph, vector and memory tables."""
