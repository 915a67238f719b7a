"""Column helpers: each takes Columns and returns a Column, and stays in the JVM."""
