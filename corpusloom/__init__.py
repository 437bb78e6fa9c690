"""corpusloom: corpus preparation, retrieval and evaluation as Spark DataFrames."""

__version__ = "0.1.0"
