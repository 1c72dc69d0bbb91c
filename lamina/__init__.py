"""lamina: tables, rasters and objects of segmented image sections on Spark.

A section is an image held as a pixel table, one row per pixel with its keys
and coordinates.  Everything is a function from DataFrames to DataFrames.
"""

__version__ = "0.1.0"
