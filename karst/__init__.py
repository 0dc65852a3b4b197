"""karst: a PySpark-native engine for append-only and write-once data."""
