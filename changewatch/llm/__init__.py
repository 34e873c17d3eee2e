"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage; see ``queries.py`` for
the queries it registers and ``corpus_pipeline.py`` for the pipeline.
"""
