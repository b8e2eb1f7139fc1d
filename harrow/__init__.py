"""harrow: a PySpark-native analytics engine for aggregated listings."""
