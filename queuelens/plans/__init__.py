"""How operators are put together: written stages, shared plan shapes, the registry."""
