"""Column functions: text cleaning, tokens, similarity, ladders, stable ids."""
