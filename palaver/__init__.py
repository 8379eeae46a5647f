"""Conversation and transcript analytics as PySpark DataFrame operators."""
