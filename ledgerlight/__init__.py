"""A PySpark-native engine for evidence-grounded question answering over periodic business documents."""
