"""Column functions: geography, statistics, text and labels."""
