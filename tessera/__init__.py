"""A PySpark-native engine for raster and array data."""
