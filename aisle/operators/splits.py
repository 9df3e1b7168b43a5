"""Time-ordered splits, sequences and negative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aisle import skew
from aisle.functions.text import hashed_int
from aisle.operators.counting import draw_unlisted


def leave_one_out(
    interactions: DataFrame, row_key: str = "event_id", val_last_n: int = 1, test_last_n: int = 1
) -> DataFrame:
    """Add ``split``: each user's last events are test, the ones before val, the rest train.

    Ordered by (timestamp, ``row_key``). Only the last few rows per user are ever gathered, and
    the label returns over the unique row key, so a user with very many events costs no more.
    """
    last = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), F.col(row_key).desc())
    held = max(0, val_last_n) + max(0, test_last_n)
    tail = (
        interactions.select("user_id", "timestamp", row_key)
        .withColumn("_back", F.row_number().over(last))
        .where(F.col("_back") <= held)
        .select(
            row_key,
            F.when(F.col("_back") <= max(0, test_last_n), "test").otherwise("val").alias("split"),
        )
    )
    return interactions.join(tail, row_key, "left").withColumn(
        "split", F.coalesce("split", F.lit("train"))
    )


def iso_timestamp(c: Column | str) -> Column:
    """ISO text whose fraction is left out when zero and never shortened otherwise."""
    value = F.col(c) if isinstance(c, str) else c
    whole = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(value, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def sequence_positions(interactions: DataFrame, keys_from: DataFrame | None = None) -> DataFrame:
    """Each event with its 1-based place in the user's history; hot users are cut into ranges."""
    order = [F.col("timestamp"), F.col("item_id")]
    tie = ["item_id", "timestamp"]
    if "event_id" in interactions.columns:
        order.append(F.col("event_id"))
        tie.append("event_id")
    return skew.row_number(interactions, "user_id", order, "position", tie, keys_from=keys_from)


def user_sequences(interactions: DataFrame, part_rows: int | None = None) -> DataFrame:
    """One row per user holding parallel, time-ordered arrays.

    This is the export shape, one array row per user by definition. With ``part_rows`` a history is cut
    into rows of at most so many events with a ``part`` number from 0, so that no row or task grows
    with a user; ``sequence_positions`` is the same content with a row per event.
    """
    event = F.struct(
        "timestamp", "item_id", *(["event_id"] if "event_id" in interactions.columns else []),
        "event_type", F.col("event_weight").cast("double").alias("event_weight"),
    )
    keys = ["user_id"]
    if part_rows is not None:
        interactions = _cut(sequence_positions(interactions), part_rows).withColumnRenamed("_cut", "part")
        keys.append("part")
    grouped = interactions.groupBy(*keys).agg(F.sort_array(F.collect_list(event)).alias("e"))
    return grouped.select(
        *keys,
        F.col("e.item_id").alias("item_sequence"),
        F.transform("e", lambda x: iso_timestamp(x["timestamp"])).alias("timestamp_sequence"),
        F.col("e.event_type").alias("event_type_sequence"),
        F.col("e.event_weight").alias("event_weight_sequence"),
        F.size("e").alias("sequence_length"),
    )


#: Events of a history that one task looks at together.
CUT_ROWS = 100_000


def _cut(placed: DataFrame, rows: int) -> DataFrame:
    """Numbers the pieces of ``rows`` positions that a history is cut into."""
    return placed.withColumn("_cut", F.floor((F.col("position") - 1) / rows))


def last_rows(placed: DataFrame, value: str, count: int, name: str, rows: int = CUT_ROWS) -> DataFrame:
    """Adds the array of the ``count`` values before each position of its user, oldest first.

    Histories are cut into pieces, and each piece also gets the last ``count`` rows of the one before,
    so a window never spans a whole history.
    """
    rows = max(rows, count)
    cut = _cut(placed, rows)
    last = (F.col("position") - 1) % rows >= rows - count
    pieces = F.array(F.struct(F.col("_cut"), F.lit(False).alias("_carried")))
    carried = F.array(F.struct((F.col("_cut") + 1).alias("_cut"), F.lit(True).alias("_carried")))
    spread = cut.withColumn("_in", F.explode(F.when(last, F.concat(pieces, carried)).otherwise(pieces)))
    window = Window.partitionBy("user_id", "_in._cut").orderBy("position").rowsBetween(-count, -1)
    return (
        spread.withColumn(name, F.collect_list(value).over(window))
        .where(~F.col("_in._carried"))
        .drop("_in", "_cut")
    )


def item_index(*frames: DataFrame) -> DataFrame:
    """Sorted distinct item ids of all frames numbered from 1; 0 stays free for padding."""
    ids = frames[0].select("item_id")
    for frame in frames[1:]:
        ids = ids.unionByName(frame.select("item_id"))
    distinct = ids.where("item_id is not null").distinct()
    return skew.row_number(distinct, [], [F.col("item_id")], "item_idx", ["item_id"])


def encode_interactions(interactions: DataFrame, index: DataFrame) -> DataFrame:
    return skew.join(interactions, index, "item_id", keys_from=interactions)


def pad_left(sequence: Column, length: int) -> Column:
    """The last ``length`` entries, zero-filled on the left."""
    kept = F.when(F.size(sequence) > length, F.slice(sequence, -length, length)).otherwise(sequence)
    missing = F.greatest(F.lit(length) - F.size(sequence), F.lit(0))
    return F.concat(F.array_repeat(F.lit(0).cast("long"), missing), kept)


def prefix_examples(
    train: DataFrame,
    index: DataFrame,
    max_seq_len: int = 20,
    min_seq_len: int = 2,
    with_seen: bool = True,
) -> DataFrame:
    """Every prefix of a history with its next item.

    The padded input comes from pieces of a history that overlap by ``max_seq_len``. ``seen_ids`` repeats the whole
    prefix in each row by definition; ``first_seen`` is the linear-size form of the same facts.
    """
    encoded = sequence_positions(encode_interactions(train, index), keys_from=train)
    encoded = last_rows(encoded, "item_idx", max_seq_len, "_recent")
    columns = ["user_id", "position", pad_left(F.col("_recent"), max_seq_len).alias("input_ids")]
    columns.append(F.col("item_idx").alias("target_id"))
    if with_seen:
        by_user = Window.partitionBy("user_id").orderBy("position")
        before = by_user.rowsBetween(Window.unboundedPreceding, -1)
        columns.append(F.array_sort(F.collect_set("item_idx").over(before)).alias("seen_ids"))
    out = encoded.select(*columns).where("position > 1")
    if min_seq_len > 2:
        sizes = encoded.groupBy("user_id").count().where(F.col("count") >= min_seq_len)
        out = skew.join(out, sizes.select("user_id"), "user_id", "left_semi")
    return out


def first_seen(train: DataFrame, index: DataFrame) -> DataFrame:
    """First position of each item in a history: seen before p means ``first_position < p``."""
    encoded = sequence_positions(encode_interactions(train, index), keys_from=train)
    return encoded.groupBy("user_id", "item_idx").agg(F.min("position").alias("first_position"))


def eval_examples(
    train: DataFrame,
    held_out: DataFrame,
    index: DataFrame,
    max_seq_len: int = 20,
    with_seen: bool = True,
) -> DataFrame:
    """One row per held-out user that has train history.

    ``seen_ids`` lists the user's whole catalog; without it ``first_seen`` tells the same in rows.
    """
    history = sequence_positions(encode_interactions(train, index), keys_from=train)
    latest = Window.partitionBy("user_id").orderBy(F.col("position").desc())
    recent = (
        history.withColumn("_back", F.row_number().over(latest))
        .where(F.col("_back") <= max_seq_len)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("position", "item_idx"))).alias("e"))
        .select("user_id", pad_left(F.col("e.item_idx"), max_seq_len).alias("input_ids"))
    )
    targets = (
        encode_interactions(held_out, index)
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("item_idx")).alias("target_ids"))
    )
    out = targets.join(recent, "user_id")
    if not with_seen:
        return out
    seen = history.groupBy("user_id").agg(F.array_sort(F.collect_set("item_idx")).alias("seen_ids"))
    return out.join(seen, "user_id")


def negative_sampling(
    interactions: DataFrame, catalog: DataFrame, per_positive: int = 5, seed: int = 42
) -> DataFrame:
    """For each positive row, distinct catalog items its user never touched.

    The unseen items of a user are addressed by number and never listed, see ``draw_unlisted``.
    """
    index = item_index(catalog)
    catalog_size = index.agg(F.count("*")).scalar()
    pairs = interactions.select("user_id", "item_id").distinct()
    seen = skew.join(pairs, index, "item_id", keys_from=interactions).select("user_id", "item_idx")
    seen_counts = seen.groupBy("user_id").agg(F.count("*").alias("_seen"))
    kept = [c for c in ("event_id", "split") if c in interactions.columns]
    free = catalog_size - F.coalesce("_seen", F.lit(0))
    draws = (
        skew.join(
            interactions.select("user_id", "item_id", *kept),
            seen_counts,
            "user_id",
            "left",
            keys_from=interactions,
        )
        .withColumn("_free", free)
        .where("_free > 0")
        .withColumn("_k", F.least(F.lit(per_positive).cast("long"), F.col("_free")))
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1)))
        .drop("_seen")
    )
    row = ["user_id", "item_id", *[c for c in kept if c == "event_id"]]
    chosen = draw_unlisted(
        draws, seen, ["user_id"], hashed_int(F.lit(seed), *row, "draw"), catalog_size,
        keys_from=interactions,
    )
    names = index.select("item_idx", F.col("item_id").alias("negative_item_id"))
    positives = chosen.withColumnRenamed("item_id", "positive_item_id")
    return skew.join(positives, names, "item_idx").drop("item_idx")


def uniform_negative_ids(
    examples: DataFrame, num_items: Column, count: int, keys: list[str], seed: int = 42
) -> DataFrame:
    """``count`` item numbers per example that differ from its positive ``target_id`` only."""
    draw = F.explode(F.sequence(F.lit(1), F.lit(count)))
    others = F.greatest(num_items - 1, F.lit(1))
    value = hashed_int(F.lit(seed), *keys, "draw") % others + 1
    shifted = F.when((value >= F.col("target_id")) & (num_items > 1), value + 1).otherwise(value)
    return examples.withColumn("draw", draw).withColumn("negative_id", shifted)


def query_split(query_id: Column | str, seed: int = 42) -> Column:
    """80/10/10 split drawn from the hash of the query id."""
    part = hashed_int(F.lit(seed), query_id) % 100
    return F.when(part < 80, "train").when(part < 90, "val").otherwise("test")


