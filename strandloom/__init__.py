"""strandloom: a PySpark engine for sequence, link and corpus tables."""
