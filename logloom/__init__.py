"""Log analytics on Spark: partitioned, append-only message logs and their operational data as DataFrames."""
