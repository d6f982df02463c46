"""Reading and writing measurement files."""
