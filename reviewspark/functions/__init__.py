"""Column expressions: labels, ratings, texts, lists, heuristics."""
