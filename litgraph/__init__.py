"""litgraph: literature-graph analytics on Spark DataFrames."""
