"""The plans of corpusloom."""
