"""Column expressions and ranking helpers; nothing here leaves the JVM."""
