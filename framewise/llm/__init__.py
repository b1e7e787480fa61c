"""Operators for preparing language-model training data.

Nothing outside this folder imports it; `corpus_pipeline.py` at the top of the
repository and the tests in `tests/llm` are its only users.
"""
