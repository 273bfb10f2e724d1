"""tidewell: rest-activity rhythm analytics on Spark DataFrames."""
