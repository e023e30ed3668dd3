"""stemweave: a PySpark-native engine for word-origin and place-name evidence tables."""
