"""Column functions with the semantics of the object model."""
