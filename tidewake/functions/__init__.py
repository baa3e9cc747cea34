"""Column functions: text, statistics, time."""
