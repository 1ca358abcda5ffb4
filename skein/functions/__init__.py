"""Column functions: plain expressions that stay inside the JVM unless said otherwise."""
