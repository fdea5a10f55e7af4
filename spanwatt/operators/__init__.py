"""DataFrame operators of the rating jobs."""
