"""DataFrame operators. Each is lazy; none collects unless its docstring says so."""
