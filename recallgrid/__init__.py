"""Graph retrieval and analytics on PySpark."""
