"""Document-corpus analytics on Spark: gates, dedup, retrieval, graph and usage operators as DataFrame transformations."""
