"""A PySpark analytics engine for publishing and document data."""
