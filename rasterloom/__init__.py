"""Multi-resolution raster analytics on Spark."""
