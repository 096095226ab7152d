"""Column-level helpers (JVM-side built-ins only)."""
