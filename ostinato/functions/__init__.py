"""Column functions: vectors, pitch classes and chord tokens."""
