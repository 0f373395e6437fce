"""PySpark-native analytics engine for long-term agent memory."""
