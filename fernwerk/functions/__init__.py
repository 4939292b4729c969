"""Column expressions over arrays of numbers."""
