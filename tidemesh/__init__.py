"""Change analytics for multitemporal and 4D point clouds on Spark DataFrames."""

__version__ = "0.1.0"
