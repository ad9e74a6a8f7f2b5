"""Column functions. All but the stemmer are built from JVM-side expressions."""
