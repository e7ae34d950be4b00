"""Token-potential analytics on Spark: operators as functions from DataFrame to DataFrame."""
