"""ledgerlens: a PySpark-native engine for auditing large entity tables."""
