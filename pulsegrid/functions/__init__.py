"""Column expressions of the signal model: everything here stays in the JVM."""
