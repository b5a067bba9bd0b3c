"""actweave: a PySpark-native engine for hierarchical document corpora and their citation graph."""
