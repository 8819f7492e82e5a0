"""tessera: a PySpark-native engine for structured-extraction training data."""
