"""Spark-native analytics over conversational memory: logs, facts, entities, retrieval and upkeep."""
