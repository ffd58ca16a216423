"""Larkspur: conversational-retrieval analytics expressed as Spark DataFrame plans."""
