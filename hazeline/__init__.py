"""A PySpark-native engine for hourly environmental time series: cleaning, joins, features, statistics, models."""
