"""Sources of item responses."""
