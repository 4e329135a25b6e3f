"""A PySpark-native engine for job-posting analytics."""
