"""The sources of corpusloom."""
