"""A PySpark-native engine for repeatable document ingestion, lineage and audit."""
