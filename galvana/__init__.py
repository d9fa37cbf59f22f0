"""galvana: Spark-native analytics for battery cycling data."""
