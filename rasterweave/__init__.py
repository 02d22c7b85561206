"""Image analytics as relational plans on Apache Spark."""

__version__ = "0.1.0"
