"""Spark jobs that prepare translation corpora and run batch inference over them."""
