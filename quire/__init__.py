"""quire: a PySpark-native analytics engine for linked document collections."""
