"""Does a neighbourhood graph help a classifier on held-out groups? The whole study as Spark DataFrames."""
