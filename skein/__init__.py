"""skein: JSON document validation and reshaping on Spark DataFrames."""

__version__ = "0.1.0"
