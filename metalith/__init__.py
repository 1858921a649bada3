"""metalith: filesystem-metadata analytics on Spark DataFrames."""
