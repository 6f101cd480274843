"""No operator of the inventory works on streams; time stepping is a loop of the solvers."""
