"""garimpo: retrieval, text, graph and usage analytics over Spark DataFrames."""
