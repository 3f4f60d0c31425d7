"""Column functions: cleaning, canonical target sets, vectors, chance expectations."""
