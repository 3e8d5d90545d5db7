"""sillar: a PySpark-native engine for source-code and document corpora."""
