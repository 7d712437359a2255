"""censo: registry analytics on Spark DataFrames."""
