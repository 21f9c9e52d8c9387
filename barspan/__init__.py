"""PySpark-native analysis of market bars and other timestamped price-like tables."""
