"""The functions of corpusloom."""
