"""Operators of a training-data pipeline: token counts, chat formatting, quality
rules, SentencePiece, line and document near-duplicates, HTML extraction,
decontamination, toxicity and language-model scores.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
