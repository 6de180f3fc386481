"""Find security problems in large collections of source files with Spark jobs."""

__version__ = "0.1.0"
