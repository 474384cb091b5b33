"""bookloom: analytics over large document collections, expressed as Spark jobs."""

__version__ = "0.1.0"
