"""Financial time-series and machine-learning research operators on Spark DataFrames."""
