"""lakeloom: a lakehouse analytics library written directly on PySpark's DataFrame, SQL and streaming APIs."""

__version__ = "0.1.0"
