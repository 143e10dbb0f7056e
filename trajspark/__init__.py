"""PySpark-native analytics for ensembles of ordered time series."""
