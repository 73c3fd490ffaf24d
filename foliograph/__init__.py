"""foliograph: page-graph analytics and text processing as Spark DataFrame plans."""

__version__ = "0.1.0"
