"""A PySpark-native relational and training-data engine."""
