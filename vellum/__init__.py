"""vellum: document-processing and text-quality analytics on Spark DataFrames."""
