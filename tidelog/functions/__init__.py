"""Column expressions and message declarations."""
