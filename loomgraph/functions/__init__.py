"""Column functions for names and labels."""
