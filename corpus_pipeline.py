"""From raw documents to token ids: quality, near duplicates, substrings, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it returns
is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landmesh.llm.bpe import digests
from landmesh.llm.common import materialize, table
from landmesh.llm.decontaminate import clean
from landmesh.llm.jaccard_join import groups_of, keyed
from landmesh.llm.quality import keep, learn_from
from landmesh.llm.substring_dedup import removal


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject.

    Each row is judged by its text, whatever its id; null and empty texts go. Without labels the
    base rules judge alone. An empty table stays empty.
    """
    rules = learn_from(docs, table(spark, sf_dir, "labels"))
    return keep(docs, rules)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates.

    Of rows of one id one stays if they are near duplicates, else all; a null id is the smallest.
    """
    rows = keyed(docs)
    stay = groups_of(rows).filter("row_key = first_key").select("row_key")
    return rows.join(stay.hint("shuffle_hash"), "row_key", "left_semi").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that a document of smaller id has too.

    Documents that lose nothing keep their text as it is, null and empty ones too; those that lose
    all their words go. A null id is the smallest, rows of one id don't take from each other. An
    empty table stays empty.
    """
    out = removal(docs, carry=tuple(docs.columns)).filter("n_removed = 0 or n_removed < n_words")
    less = {"text": F.col("kept"), "n_chars": F.length("kept")}
    old = {c: F.col(f"carry.`{c}`") for c in docs.columns}
    new = {c: F.when(F.col("n_removed") > 0, v.cast(docs.schema[c].dataType)).otherwise(old[c]) for c, v in less.items() if c in old}
    return out.select(*((new.get(c, old[c])).alias(c) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay, and every row is looked at by itself; items without words match
    nothing. An empty table stays empty.
    """
    return clean(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of each document's ids and decoded text.

    A row for each row, also of null or repeated id; a null text counts as empty.
    """
    return digests(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near), ("substring dedup", substrings), ("benchmark decontamination", decontaminate), ("BPE", bpe)]

#: The learned rules, components and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
