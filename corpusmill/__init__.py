"""corpusmill: text-corpus curation and evaluation analytics on Spark DataFrames."""
