"""Source-construct analytics for large collections of Go code, on Spark DataFrames."""
