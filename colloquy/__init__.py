"""Conversation, interval and training-data analytics on PySpark."""
