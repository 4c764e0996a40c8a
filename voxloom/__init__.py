"""Conversation analytics on Spark: timed words, speaker intervals and job tables at corpus scale."""
