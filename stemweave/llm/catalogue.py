"""The queries of the training-data operators and their oracles."""

from __future__ import annotations

from . import chat_format, decontamination, line_dedup, ngram_jaccard, order_minhash, periodic_runs, quality, sentencepiece_codec, substring_dedup, token_counts, toxicity, vector_codes, warc

MODULES = (ngram_jaccard, sentencepiece_codec, warc, line_dedup, order_minhash, decontamination, quality, token_counts, toxicity, chat_format, vector_codes, substring_dedup, periodic_runs)

QUERIES = {name: value for module in MODULES for name, value in vars(module).items() if name.startswith("op") and name[2].isdigit()}
ORACLES = {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE", {}).items()}
