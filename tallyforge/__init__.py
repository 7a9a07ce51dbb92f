"""PySpark-native data-quality and price-analytics engine."""
