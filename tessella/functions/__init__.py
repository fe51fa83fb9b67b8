"""Column-level building blocks (no shuffles, JVM-side expressions)."""
