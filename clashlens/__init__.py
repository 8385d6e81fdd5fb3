"""clashlens: contradiction mining over tables of documents, expressed as Spark jobs."""

__version__ = "0.1.0"
