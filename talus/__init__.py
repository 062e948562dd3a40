"""talus: a PySpark-native engine for support-desk data (tickets, documents, chunks, evidence, evaluation)."""

__version__ = "0.1.0"
