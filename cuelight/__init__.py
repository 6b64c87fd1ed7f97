"""Hint-driven media analytics on PySpark: DataFrame operators, a semantic planner and an engine that runs its plans."""

__all__ = ["__version__"]

__version__ = "0.1.0"
