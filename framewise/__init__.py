"""framewise: a Spark-native engine for multimodal shot retrieval and the dataflow around it."""

__version__ = "0.1.0"
