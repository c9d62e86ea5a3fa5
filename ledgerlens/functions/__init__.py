"""Column functions: names, dates, tax arithmetic, similarity and report text."""
