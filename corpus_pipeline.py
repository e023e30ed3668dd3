"""The corpus pipeline: each stage is written as Parquet and reread by the next."""

from __future__ import annotations

from stemweave.llm.common import materialize, table
from stemweave.llm.decontamination import drop_contaminated
from stemweave.llm.line_dedup import dedup_lines
from stemweave.llm.ngram_jaccard import keep_one_per_component
from stemweave.llm.sentencepiece_codec import pieces_of
from stemweave.llm.toxicity import drop_toxic


def toxicity(spark, docs, sf_dir):
    """Documents that the classifier calls toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """Cross-site boilerplate lines are cut; documents that were nothing else go."""
    return dedup_lines(docs)


def ngram_jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return keep_one_per_component(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark window go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark, docs, sf_dir):
    """Piece ids of every kept document, and the proof that they decode to its text."""
    return pieces_of(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("sentencepiece", sentencepiece),
]

#: neither the classifier nor the Viterbi search can be put into SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
