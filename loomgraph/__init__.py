"""Knowledge-graph indexing and retrieval as Spark jobs."""
