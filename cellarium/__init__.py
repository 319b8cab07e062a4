"""Cell-store analytics on PySpark: sparse, multi-versioned tables as DataFrames."""
