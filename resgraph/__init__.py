"""Resource-graph analytics on PySpark."""
