"""Source-tree and version-history analytics on PySpark."""
