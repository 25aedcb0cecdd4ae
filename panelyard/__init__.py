"""Panel and intraday factor analytics on Spark DataFrames."""
