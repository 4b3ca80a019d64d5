"""A PySpark-native analytics engine for website audits and search performance."""
