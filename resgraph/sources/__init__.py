"""Sources: star tables, binary packages, source-text projects."""
