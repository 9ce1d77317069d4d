"""A PySpark engine for retrieval, answer evaluation and dataset building."""
