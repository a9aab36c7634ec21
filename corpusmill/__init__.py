"""corpusmill: a PySpark-native engine for document retrieval, guardrails and corpus analytics."""
