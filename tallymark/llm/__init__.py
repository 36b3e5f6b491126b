"""Operators for large-scale training-data pipelines.

Nothing outside this folder (but for the registration in ``__spark_entry__``
and ``corpus_pipeline``) imports it.
"""
