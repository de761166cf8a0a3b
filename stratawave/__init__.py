"""stratawave: Spark-native analytics for gap-ridden time series and for auditing answers about them."""
