"""Expression builders: text predicates with Python's semantics, in the dialects that plans are written in."""
