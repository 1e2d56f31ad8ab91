"""sparkann: vector similarity search, clustering, private retrieval and evaluation on Spark DataFrames."""
