"""A PySpark-native analytics engine for corpora of user-written text."""
