"""Column factories: exact integer arithmetic, lifts, colour and statistics."""
