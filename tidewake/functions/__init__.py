"""Column-returning functions; all run inside the JVM unless stated otherwise."""
