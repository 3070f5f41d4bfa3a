"""Column-level functions: property predicates and texts."""
