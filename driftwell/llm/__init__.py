"""Operators for preparing training text at scale.

Nothing outside this subpackage (but ``corpus_pipeline.py``) imports it; each
module holds one operator, and ``registry`` turns them into queries.
"""
