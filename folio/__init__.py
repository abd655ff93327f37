"""folio: document analytics and hybrid retrieval on Spark DataFrames."""

__version__ = "0.1.0"
