"""Map messy tables onto a target schema with Spark DataFrames."""
