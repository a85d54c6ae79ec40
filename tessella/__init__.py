"""Document analytics on PySpark: extraction, cost estimates, chunking, model stages, state and rendering as DataFrames."""
