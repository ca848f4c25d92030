"""Column-level building blocks; everything here stays inside the JVM."""
