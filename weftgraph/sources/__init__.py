"""Front ends that produce a graph."""
