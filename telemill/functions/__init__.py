"""Column functions: pure expressions, no shuffles, all evaluated inside the JVM."""
