"""PySpark-native engine for grounding, evaluating and reconciling data extracted from business documents."""
