"""Column expressions: features, fixed-point vectors, decisions, scores. All stay in generated JVM code."""
