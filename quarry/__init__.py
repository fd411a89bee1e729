"""quarry: dataframe-style analytics on Spark DataFrames and Catalyst."""
