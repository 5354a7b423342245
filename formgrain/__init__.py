"""formgrain: form-record analytics on Spark DataFrames."""
