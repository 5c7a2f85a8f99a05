"""quarrylight: a Spark-native retrieval and context-assembly engine."""

__version__ = "0.1.0"
