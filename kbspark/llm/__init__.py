"""Operators of a training-data pipeline, each over whole tables.

Nothing outside this folder (but ``corpus_pipeline.py`` and the guarded part
of ``__spark_entry__.py``) imports it.
"""
