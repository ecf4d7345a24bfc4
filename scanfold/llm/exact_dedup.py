"""Exact duplicates: group by a 128-bit content hash, keep the smallest id, compare bytes in groups.

Rows without a text count as empty texts, which are equal to each other. An id that is null is
never the smallest while the group has another one. Rows with both the same id and equal texts are
the same document: all of them are marked as kept, and ``drop_exact_duplicates`` leaves one of
them. An empty table gives an empty result. Only the two named columns are read by
``exact_groups``, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.llm.common import SPACES, spare, text_of
from scanfold.sources.workspace import stored


def normalised(text: str | Column) -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_of(text), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _groups(texts: DataFrame) -> DataFrame:
    """hash, keep, size, same for each content hash; ``texts`` has id, hash, text.

    The byte comparison is an aggregate: a group holds one text exactly when its smallest and its
    largest text are the same bytes. It is combined before the shuffle, so a group of any size
    sends one row per task and never meets in one place.
    """
    return texts.groupBy("hash").agg(
        F.min("id").alias("keep"), F.count("*").alias("size"),
        (F.min("text") == F.max("text")).alias("same"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 hash_of=content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Hashes whose group holds different texts are grouped once more by the texts themselves.
    """
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("text"))
    texts = texts.select("id", "text", hash_of(F.col("text")).alias("hash"))
    groups = stored(_groups(texts), "exact-groups")
    light = texts.select("id", "hash", F.sha2("text", 256).alias("text_sha256"))
    found = light.join(groups.filter("same").drop("same"), "hash").select("id", "keep", "size", "text_sha256")
    mixed = groups.filter("not same").select("hash")
    if not mixed.isEmpty():
        apart = texts.join(mixed, "hash")
        by_text = stored(apart.groupBy("hash", "text").agg(
            F.min("id").alias("keep"), F.count("*").alias("size")), "exact-collisions")
        found = found.unionByName(apart.join(by_text, ["hash", "text"]).select(
            "id", "keep", "size", F.sha2("text", 256).alias("text_sha256")))
    return found.select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with all their columns, one for each different text."""
    sha = spare(docs, "text_sha256")
    rows = docs.withColumn(sha, F.sha2(normalised(text_col), 256))
    marks = exact_groups(docs, id_col, text_col)
    keepers = stored(marks.filter("kept").select(
        F.col(id_col).alias("keep"), F.col("text_sha256").alias("sha")).groupBy("keep", "sha").agg(
            F.count("*").alias("rows")), "exact-keepers")

    def chosen(which: DataFrame) -> DataFrame:
        return rows.join(which, rows[id_col].eqNullSafe(which["keep"]) & (rows[sha] == which["sha"]),
                         "left_semi")

    kept = chosen(keepers.filter("rows = 1"))
    repeated = keepers.filter("rows > 1")
    if not repeated.isEmpty():
        kept = kept.unionByName(chosen(repeated).dropDuplicates([id_col, sha]))
    return kept.drop(sha)
