"""Column -> Column building blocks; all of them stay on the JVM."""
