"""Column functions: alphabets, distances and scores."""
