"""Column expressions: nothing here runs a job or leaves the JVM."""
