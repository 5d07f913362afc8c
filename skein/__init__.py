"""Session search and corpus operators on Spark DataFrames."""
