"""folio: a Spark-native engine that turns documents into Markdown and shapes text tables."""

__version__ = "0.1.0"
