"""gleaner: a PySpark-native document-analytics engine."""
