"""Column builders: every function takes and returns Columns, and stays within generated code."""
