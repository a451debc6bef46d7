"""corpusloom: corpus analytics on Spark DataFrames."""
