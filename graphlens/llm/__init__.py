"""Corpus operators for training-data pipelines. Nothing else in graphlens imports this."""
