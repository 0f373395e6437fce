"""Column expressions; anything that can stay in the JVM does."""
