"""foliograph: page-layout and corpus analytics as plain Spark DataFrame plans."""

__version__ = "0.1.0"
