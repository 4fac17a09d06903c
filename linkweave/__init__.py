"""linkweave: evidence-based record linkage as PySpark DataFrame jobs."""

__version__ = "0.1.0"
