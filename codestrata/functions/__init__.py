"""Column functions: paths, addresses, source text, roles. All are built from Spark functions and stay in the JVM."""
