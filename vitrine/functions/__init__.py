"""Column-expression helpers (value coercion, guarded maths, rule compiler)."""
