"""The corpus pipeline: stages over ``documents``, each reading what the one before it wrote.

Toxic documents go; lines that many documents share go from all but one of
them; of each group of near-duplicates the document of the smallest id stays;
sources are mixed to their target weights, so that documents repeat or drop
out; what is left is packed into sequences.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from tidemark.llm import line_dedup, mixing, near_dedup, packing, toxicity
from tidemark.llm.common import materialize, table


def toxicity_stage(spark, docs, sf_dir):
    """Documents whose score stays below the threshold."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark, docs, sf_dir):
    """Every document, without its lines that at least five documents share, and with its new length."""
    return line_dedup.deduped(docs, length_col="n_chars")


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group that links of five-word shingle similarity 0.8 or more connect."""
    return near_dedup.deduped(docs, threshold=0.8)


def mixing_stage(spark, docs, sf_dir):
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of documents in sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Classifier, sketches, seeded hashes and tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages' outcome over ``documents``: a row for each piece, see ``packing``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
