"""System-call trace analytics on Spark DataFrames."""
