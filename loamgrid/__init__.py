"""loamgrid: corpus curation, retrieval and evaluation analytics on Spark DataFrames."""
