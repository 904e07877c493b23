"""millrace: recipe-driven data preparation on Spark DataFrames."""
