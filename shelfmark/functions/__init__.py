"""Column builders used by every operator."""
