"""sheaf: archives, listings, sync plans and training corpora as Spark DataFrames."""
