"""tessera: label-mask time series, object lineages and their analytics on PySpark."""
