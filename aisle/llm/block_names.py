"""Exact dedup by deterministic block naming, DataFrame functions only.

Texts are cut into blocks of fixed size. The distinct blocks are sorted into integer names; then
adjacent names are paired and the distinct pairs sorted into names again, until one name is left of
each document. Documents of as many blocks are equal if and only if their last names are.

Blocks are combined before they are shuffled, so a group of copies moves one block per task. The
names come back to the documents through a 64-bit index of the blocks; where two different blocks
share an index value, which the sorted sets show, those are told apart by their content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm.common import by_size, materialise, ranked, running

BLOCK_BYTES = 16_384
#: A group with this share of all rows is joined without moving its rows.
HOT_SHARE = 1_000


def _blocks(text: str, size: int) -> Column:
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    count = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.substring(data, i * size + 1, F.lit(size))
    )


def _named_blocks(
    docs: DataFrame, text: str, size: int, index: Callable[[Column], Column]
) -> DataFrame:
    """``docs`` without text, one row per block: ``_at``, ``_blocks`` (their number) and ``_name``."""
    parts = F.posexplode(_blocks(text, size)).alias("_at", "_block")
    sets = (
        docs.select(F.explode(_blocks(text, size)).alias("_block"))
        .select(index(F.col("_block")).alias("_index"), "_block")
        .groupBy("_index")
        .agg(F.array_sort(F.collect_set("_block")).alias("_set"))
        .select(
            "_index",
            F.size("_set").cast("long").alias("_n"),
            F.when(F.size("_set") > 1, F.col("_set")).alias("_set"),
        )
    )
    names = running(sets, ["_index"], "_n", "block-names", "_first")
    shared = not names.where("_n > 1").isEmpty()
    total = F.greatest(F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / size), F.lit(1))
    rows = docs.withColumn("_blocks", total.cast("int"))
    others = [c for c in docs.columns if c != text]
    rows = rows.select(*others, "_blocks", parts).withColumn("_index", index(F.col("_block")))
    if not shared:
        rows = rows.drop("_block")
        named = rows.join(names, "_index").withColumn("_name", F.col("_first") + 1)
    else:
        inside = F.when(F.col("_n") > 1, F.array_position("_set", F.col("_block"))).otherwise(1)
        named = rows.join(names, "_index").withColumn("_name", F.col("_first") + inside)
    return named.select(*others, "_blocks", "_at", F.col("_name").cast("long").alias("_name"))


def document_names(
    docs: DataFrame,
    text: str = "text",
    row: str = "_row",
    size: int = BLOCK_BYTES,
    index: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs`` without its text, with ``_blocks`` and ``_name``.

    Two rows agree in both if and only if their texts are equal; null counts as empty. ``row``
    names a column that is unique.
    """
    base = materialise(_named_blocks(docs, text, size, index), "blocks")
    done = [base.where("_blocks = 1").drop("_at")]
    others = [c for c in docs.columns if c not in (text, row)]
    heads = base.where("_blocks > 1 and _at = 0").select(row, *others)
    rest = base.where("_blocks > 1").select(row, "_blocks", "_at", "_name")
    most = rest.agg(F.max("_blocks")).first()[0] or 1
    level, reach = 0, 2
    while reach < 2 * most:
        level += 1
        even = F.pmod("_at", F.lit(2)) == 0
        pairs = rest.groupBy(row, "_blocks", F.floor(F.col("_at") / 2).alias("_at")).agg(
            F.max(F.when(even, F.col("_name"))).alias("_left"),
            F.coalesce(F.max(F.when(~even, F.col("_name"))), F.lit(0)).alias("_right"),
        )
        pairs = materialise(pairs, "pairs")
        distinct = pairs.select("_left", "_right").distinct()
        names = ranked(distinct, ["_left", "_right"], f"pair-names-{level}", "_name")
        named = pairs.join(names, ["_left", "_right"]).select(
            row, "_blocks", "_at", (F.col("_name") + 1).alias("_name")
        )
        rest = materialise(named, "named-pairs")
        finished = rest.where(F.col("_blocks") <= reach).select(row, "_blocks", "_name")
        done.append(heads.join(finished, row).select(*base.drop("_at").columns))
        rest = rest.where(F.col("_blocks") > reach)
        reach *= 2
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _groups(named: DataFrame, doc_id: str) -> DataFrame:
    """Adds ``_keep`` (id and row that stay) and ``group_size``."""
    keys = ["_blocks", "_name"]
    groups = named.groupBy(*keys).agg(
        F.max(F.struct(F.col(doc_id).alias("id"), F.col("_row").alias("row"))).alias("_keep"),
        F.count("*").alias("group_size"),
    )
    groups = materialise(groups, "groups")
    # groups of a thousandth of the rows or more: a thousand of them at most, wherever they are sent
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = F.col("group_size") >= max(2, -(-total // HOT_SHARE))
    marked = named.join(F.broadcast(groups.where(hot)), keys, "left")
    rest = marked.where("group_size is null").drop("_keep", "group_size")
    return marked.where("group_size is not null").unionByName(rest.join(groups.where(~hot), keys))


def exact_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    size: int = BLOCK_BYTES,
    index: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; null texts count as empty, null ids are the
    smallest, of rows that repeat in id and text one stays. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col(doc_id).alias("doc_id"),
        F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"),
        F.col(text).alias("text"),
    )
    grouped = _groups(document_names(rows, "text", "_row", size, index), "doc_id")
    return grouped.select(
        "doc_id",
        F.col("_keep.id").alias("keep_id"),
        "group_size",
        (F.col("_keep.row") == F.col("_row")).alias("kept"),
        "text_sha256",
    )


def without_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES
) -> DataFrame:
    """The documents that stay, with all their columns."""
    numbered = materialise(
        docs.withColumn("_row", F.monotonically_increasing_id()), "numbered"
    )
    rows = numbered.select("_row", F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    grouped = _groups(document_names(rows, "text", "_row", size), "doc_id")
    dropped = materialise(
        grouped.where(F.col("_keep.row") != F.col("_row")).select("_row"), "dropped"
    )
    return numbered.join(by_size(dropped), "_row", "left_anti").select(*docs.columns)
