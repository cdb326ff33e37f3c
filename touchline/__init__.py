"""PySpark-native analytics engine for sports-match data."""
