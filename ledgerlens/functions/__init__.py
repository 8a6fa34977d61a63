"""Column-level functions (JVM-side expressions, no UDFs)."""
