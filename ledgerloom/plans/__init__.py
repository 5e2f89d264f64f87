"""Building the warehouse, and the registry of queries over it."""
