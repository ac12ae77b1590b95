"""Column functions: each takes and gives Columns, all built-in expressions unless a docstring says otherwise."""
