"""shelfmark: bibliographic catalogues built and queried with Spark DataFrames."""
