"""A PySpark-native engine for photographic catalogs and raster data."""
