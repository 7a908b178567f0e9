"""Raster-field analytics on Spark: fields, stencils, grid algorithms and their sinks."""
