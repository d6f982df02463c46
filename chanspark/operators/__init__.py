"""Table operations on channel groups."""
