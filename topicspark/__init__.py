"""Multi-label text corpora on Spark DataFrames."""
