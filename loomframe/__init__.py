"""A Spark-first analytics engine: frames, predicates, statistics and arrays as DataFrame plans."""

__version__ = "0.1.0"
