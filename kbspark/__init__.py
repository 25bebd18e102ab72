"""Knowledge-base building and querying on Spark DataFrames."""
