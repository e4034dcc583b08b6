"""PySpark-native knowledge-graph building, retrieval and data processing."""
