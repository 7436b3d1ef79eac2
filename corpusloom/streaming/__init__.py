"""The streaming of corpusloom."""
