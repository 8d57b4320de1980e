"""cairn: a PySpark-native engine for archive catalogs."""
