"""Graph construction and graph search."""
