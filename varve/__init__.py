"""varve: PySpark-native analytics for irregular multi-resolution time series."""
