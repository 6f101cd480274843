"""Column functions: ids, offsets, distances."""
