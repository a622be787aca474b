"""Conversation, library and knowledge-graph analytics as Spark DataFrame operators."""
