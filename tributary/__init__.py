"""Regional frequency analysis of extremes on Spark DataFrames."""
