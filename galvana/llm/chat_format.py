"""Chat formatting of logged conversations: snapshots collapse into the longest.

A log holds a conversation again and again as it grows. A rolling hash of each
turn prefix (of role, text and place of every turn so far) is a window over the
conversation; the hash of its last turn names the whole. A conversation whose
whole is a proper prefix of another is left out by an anti-join, and of equal
ones the smallest id stays. The rest are rendered, one text each.

Turns stand in order of turn, role and text, nulls first; gaps in turn numbers
don't matter, and repeated turns count each. Rows of a null conv_id are one
conversation. A null role or text is rendered as empty, but differs from an
empty one. ``<|`` within a role or text is rendered ``< |``, so a text can't hold a
marker. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _key(column: str):
    """A conversation's key: never null, and an id that is an empty text differs from none."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("")).alias("key")


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its place, the 128-bit hash ``p, q`` of the turns up to it, and whether it is the last."""
    rows = turns.select("conv_id", "turn", "role", "text", _key("conv_id"))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    # A turn's hash holds its place, so their exclusive or depends on the order.
    parts = ["place", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    running = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumns({
        "p": F.bit_xor(F.xxhash64(*parts)).over(running),
        "q": F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(running),
        "last": F.lead(F.lit(True)).over(Window.partitionBy("key").orderBy("place")).isNull(),
    })


def _plain(column: str):
    return F.replace(F.coalesce(column, F.lit("")), F.lit("<|"), F.lit("< |"))


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies, text`` of every maximal conversation of ``turns`` (conv_id, turn, role, text)."""
    rows = prefixes(turns)
    whole = rows.where("last").groupBy("p", "q", "place").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    longer = rows.where("not last").select("p", "q", "place").distinct()
    kept = whole.join(longer, ["p", "q", "place"], "left_anti").select(
        _key("conv_id"), "n_copies", F.col("place").alias("n_turns")
    )
    turn = F.concat(F.lit("<|"), _plain("role"), F.lit("|>\n"), _plain("text"), F.lit("<|end|>\n"))
    return (
        rows.select("key", "conv_id", "place", turn.alias("turn"))
        .join(kept, "key")
        .groupBy("key")
        .agg(
            F.any_value("conv_id").alias("conv_id"),
            F.any_value("n_turns").cast("long").alias("n_turns"),
            F.any_value("n_copies").alias("n_copies"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "turn"))), lambda x: x["turn"]), "").alias("text"),
        )
        .drop("key")
    )


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, collapsed and rendered."""
    return format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP2_SQL = """
WITH placed AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns,
         coalesce('R' || length(role) || ':' || role, 'N') || coalesce('T' || length(text) || ':' || text, 'N') AS turn
  FROM conversations),
prefix AS (
  SELECT conv_id, place, n_turns, md5(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY place)) AS h FROM placed),
whole AS (
  SELECT h, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefix WHERE place = n_turns GROUP BY h, n_turns),
kept AS (
  SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefix p WHERE p.place < p.n_turns AND p.h = w.h))
SELECT k.conv_id, k.n_turns, k.n_copies,
       string_agg('<|' || replace(coalesce(t.role, ''), '<|', '< |') || '|>' || chr(10)
                  || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY t.place) AS text
FROM kept k JOIN placed t ON t.conv_id IS NOT DISTINCT FROM k.conv_id
GROUP BY k.conv_id, k.n_turns, k.n_copies
"""
