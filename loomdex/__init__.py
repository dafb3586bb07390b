"""loomdex: cross-reference and corpus analytics on Spark DataFrames."""
