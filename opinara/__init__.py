"""Customer-review analytics as lazy PySpark DataFrame transformations."""

__version__ = "0.1.0"
