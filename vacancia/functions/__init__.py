"""Column functions: each takes and returns Columns and stays inside the JVM."""
