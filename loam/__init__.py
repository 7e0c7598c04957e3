"""loam: retrieval and corpus analytics over Spark DataFrames."""
