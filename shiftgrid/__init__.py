"""PySpark-native analytics engine for feature tracking between co-registered images."""
