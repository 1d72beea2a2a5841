"""Document-package analytics on Spark DataFrames."""
