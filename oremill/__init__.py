"""oremill: hybrid retrieval, knowledge-graph analytics and agent memory on Spark DataFrames."""

__version__ = "0.1.0"
