"""lodestone: a PySpark-native engine for document archives and relational tables."""
