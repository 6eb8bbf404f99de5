"""lodestar: a PySpark-native engine for retrieval, sample and rollout analytics."""
