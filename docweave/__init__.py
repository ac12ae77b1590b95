"""Document analytics on PySpark: scan, parse, render, structure, measure."""

__version__ = "0.1.0"
