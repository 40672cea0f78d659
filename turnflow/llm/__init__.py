"""Operators of a training-data pipeline over documents, conversations and vectors.

Nothing outside this folder, its tests and `corpus_pipeline.py` imports it.
"""
