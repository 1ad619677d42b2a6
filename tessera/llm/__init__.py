"""Operators for preparing language-model training data. Nothing outside this folder
(and ``corpus_pipeline.py``) imports it; ``__spark_entry__`` adds its queries when present."""
