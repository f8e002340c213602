"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcast.llm.common import normalised
from gridcast.session import settle

# A chunk ends after the first sentence end that leaves it 256 to 4,096 characters; a text without one is cut at 4,096.
SHORTEST, LONGEST = 256, 4096
SENTENCE_END = r"(?<=[.!?;:]\x20|[。！？])"


def chunks_of(text: Column) -> Column:
    """The consecutive chunks of a text; joined they give it back."""
    rule = rf"(?s).{{{SHORTEST},{LONGEST}}}?(?:{SENTENCE_END}|\z)|.{{{LONGEST}}}|.+"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def chunk_id(chunk: Column, seed: int) -> Column:
    """128 bits of a chunk; another seed gives other identifiers."""
    return F.struct(F.xxhash64(F.lit(seed), chunk).alias("a"), F.xxhash64(chunk, F.lit(seed), F.length(chunk)).alias("b"))


def verified_seed(docs: DataFrame) -> int:
    """The first seed under which no two different chunks of the corpus share an identifier.

    The chunks are made distinct inside each task before they move, and they move once.
    """
    pieces = docs.select(F.explode(chunks_of(normalised())).alias("chunk"))
    seed = 0
    while True:
        distinct = pieces.select(chunk_id(F.col("chunk"), seed).alias("id"), "chunk").distinct()
        if distinct.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            return seed
        seed += 1


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after each run of ASCII white space becomes one space. Each text is
    a recipe, the ordered list of its chunks' verified identifiers, and only recipes are compared;
    ``keep_id`` is the smallest doc_id of an equal text.

    A null text is an empty one, and all empty texts are equal. Null doc_ids are never the smallest unless all are
    null; then ``keep_id`` is null and the rows count as kept. Rows that repeat a doc_id get one result row each,
    all with the same answer. An empty table gives an empty result; other columns are ignored.
    """
    seed = verified_seed(docs)
    text = normalised()
    recipes = settle(docs.select(
        "doc_id",
        F.transform(chunks_of(text), lambda c: chunk_id(c, seed)).alias("_recipe"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
    ))
    groups = recipes.groupBy("_recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # The struct is a key of its own, so both sides are shuffled for the join and a large group can be split.
    key = F.struct("_recipe").alias("_key")
    joined = recipes.select("doc_id", "text_sha256", key).join(groups.select(key, "keep_id", "group_size"), "_key")
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text no row with a smaller doc_id has; columns as they were.

    Of rows that repeat a doc_id and a text one stays.
    """
    kept = settle(exact_groups(docs).where("kept").select(F.col("doc_id").alias("_keep"), "text_sha256"))
    columns = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    sha = F.sha2(normalised().cast("binary"), 256)
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"), sha.alias("_sha"))
    repeated = not kept.groupBy("_keep", "text_sha256").count().where("count > 1").isEmpty()
    stay = rows.join(kept, F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_sha") == F.col("text_sha256")), "left_semi")
    return (stay.dropDuplicates(["_id", "_sha"]) if repeated else stay).select(*columns)
