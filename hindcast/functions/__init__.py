"""Column expressions: scalar building blocks that stay inside Catalyst."""
