"""Column functions: paths, text measures, identifiers. All stay in the JVM."""
