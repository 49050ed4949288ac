"""railtide: transit delay analytics and delay-data quality on Spark DataFrames."""

__version__ = "0.1.0"
