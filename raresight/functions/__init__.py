"""Column-level helpers; everything here stays inside JVM code generation."""
