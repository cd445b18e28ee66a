"""Site-visibility analytics on PySpark."""
