"""A PySpark engine for measurement files."""
