"""Column functions and helpers that run on the driver."""
