"""Index partitions, vectors, matrices, collectives and solvers."""
