"""skein: session knowledge-graph analytics expressed with Spark DataFrames."""
