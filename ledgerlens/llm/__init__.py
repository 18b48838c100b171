"""Operators for large-scale training-data preparation.

One module per operator; ``queries`` registers the thin queries over the whole tables.
Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
