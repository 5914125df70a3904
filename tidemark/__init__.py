"""Early-risk features, models and evaluation as declarative Spark jobs."""

__version__ = "0.1.0"
