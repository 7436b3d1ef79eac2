"""The operators of corpusloom."""
