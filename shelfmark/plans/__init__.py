"""Reusable plan shapes: skew-safe joins and numbering, durable cut points, compiled templates."""
