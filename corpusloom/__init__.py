"""Corpusloom: indexing, retrieval and corpus preparation as Spark plans."""
