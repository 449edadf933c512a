"""Column functions: expressions in, expressions out, all inside the JVM."""
