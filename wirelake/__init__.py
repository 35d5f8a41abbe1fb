"""wirelake: packet captures and byte corpora as Spark DataFrames."""
