"""Column functions: text checks, scoring, vectors."""
