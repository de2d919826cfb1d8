"""Results in batches, as they come."""
