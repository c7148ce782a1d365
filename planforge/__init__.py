"""Set-oriented document-geometry analytics over Spark DataFrames."""
