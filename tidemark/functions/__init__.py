"""Column-level building blocks: predicates, coercion, large objects, time arithmetic."""
