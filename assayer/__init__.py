"""assayer: evaluation analytics for retrieval and language-model applications on Spark."""

__version__ = "0.1.0"
