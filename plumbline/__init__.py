"""plumbline: audit, score and repair tables and event streams with PySpark."""

__version__ = "0.1.0"
