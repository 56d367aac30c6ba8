"""Dataset-splitting analytics on Spark DataFrames."""
