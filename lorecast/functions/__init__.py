"""Column -> Column functions: vectors, scores, text, time."""
