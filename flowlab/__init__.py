"""Network-flow analytics on Spark tables and streams."""
