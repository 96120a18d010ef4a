"""Credit-risk data mart, model building and model monitoring as Spark jobs."""

__version__ = "0.1.0"
