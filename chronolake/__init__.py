"""A telemetry analytics engine on PySpark: a lake of time series, level-of-detail queries, calculated channels, ranges."""
