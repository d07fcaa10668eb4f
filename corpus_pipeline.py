"""Documents to tokens: quality, near duplicates, benchmark leaks, personal data, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; its result is written as Parquet
in the shared folder and read again as the next one's docs. All but the last return the columns of documents.

Edge cases, the same in every stage: a null text counts as empty and stays null where it is kept; null doc_ids, repeated rows and
columns of any further name are kept as they are (near duplicates leave one row of equal texts, the least doc_id); a very long
text is read whole; ties go to the least doc_id, then the least digest of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from linkweave.llm import bpe, decontamination, pii, quality, simhash
from linkweave.llm.common import materialise, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.reject_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontamination.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark, docs, sf_dir):
    """Personal data and terms that disclose it are replaced in the texts."""
    return pii.sanitise(docs)


def encoding_stage(spark, docs, sf_dir):
    """Every text gets its tokens, which are decoded again and compared."""
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal_data", personal_data_stage),
    ("encoding", encoding_stage),
]

# The classifier, the fingerprints and the encoding are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
