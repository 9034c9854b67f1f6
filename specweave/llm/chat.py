"""Chat formatting by rotation of perspectives, in DataFrame operations only.

For every participant the dialogue is rendered once with that speaker as the assistant and the others as
named users.  Dialogues are cut into parts of PART_TURNS turns, so that no row and no group grows with the
length of a dialogue; the parts of one perspective, by part and slot, are its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.tables import stored

PART_TURNS = 32
CROWD = 32

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _messages(conversations: DataFrame) -> DataFrame:
    speaker = F.regexp_replace(F.trim(F.col("role").cast("string")), r"\s+", "_")
    # control strings in a text must not end its message
    body = F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(speaker, F.lit("")), F.lit("unknown")).alias("speaker"),
        body.alias("body"),
    )


def _dealt(messages: DataFrame) -> DataFrame:
    """``part`` and ``slot`` of every message.

    A turn with more than CROWD distinct messages is cut off: it has slots of its own, of CROWD messages by
    speaker and body, after the slot of the turns before it and before that of the turns after it.
    Messages without a turn have no place in the order: each is a part of its own.
    """
    messages = messages.withColumn("part", F.floor(F.col("turn") / F.lit(PART_TURNS)).cast("long"))
    hashed = F.xxhash64("speaker", "body")
    kinds = messages.where("turn is not null").select("conv_id", "part", "turn", hashed.alias("message")).distinct()
    crowds = kinds.groupBy("conv_id", "part", "turn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD)
    crowds = crowds.select("conv_id", "part", F.struct("turn", F.ceil(F.col("n") / CROWD).alias("slots")).alias("crowd"))
    # a list holds PART_TURNS turns at most
    crowds = stored(crowds.groupBy("conv_id", "part").agg(F.collect_list("crowd").alias("crowds")))
    placed = messages.join(crowds, ["conv_id", "part"], "left")
    crowded = F.expr("coalesce(exists(crowds, x -> x.turn = turn), false)")
    before = F.expr("coalesce(aggregate(filter(crowds, x -> x.turn < turn), 0L, (n, x) -> n + x.slots + 1), 0L)")
    plain = placed.where(~crowded).withColumn("slot", F.when(F.col("turn").isNull(), hashed).otherwise(before))
    ranked = _ranked(placed.where(crowded).withColumn("slot", before).drop("crowds").distinct())
    slot = F.col("slot") + 1 + F.floor(F.col("place") / F.lit(CROWD))
    return plain.drop("crowds").unionByName(ranked.withColumn("slot", slot.cast("long")).drop("place"))


def _ranked(messages: DataFrame) -> DataFrame:
    """``place`` of distinct messages in their turn, from 0: counted in ranges, so that no task holds a whole turn."""
    # stored, as another evaluation may draw other ranges
    ranged = messages.repartitionByRange("conv_id", "turn", "speaker", "body")
    ranged = stored(ranged.withColumn("range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "turn", "range").agg(F.count(F.lit(1)).alias("n"))
    turn = Window.partitionBy("conv_id", "turn").orderBy("range")
    below = counts.select("conv_id", "turn", "range", (F.sum("n").over(turn) - F.col("n")).alias("below"))
    own = Window.partitionBy("conv_id", "turn", "range").orderBy("speaker", "body")
    placed = ranged.withColumn("place", F.row_number().over(own) - 1).join(below, ["conv_id", "turn", "range"])
    return placed.withColumn("place", F.col("place") + F.col("below")).drop("range", "below")


def _rendered(rows: DataFrame) -> DataFrame:
    """Text, mask and counts of ``messages`` (an array) as ``speaker`` sees them."""
    own = "x.speaker = speaker"
    head = f"""concat('{OPEN}', case when x.speaker = 'system' then 'system' when {own} then 'assistant'
        else concat('user name=', x.speaker) end, '\\n')"""
    tail = CLOSE.replace("\n", "\\n")
    return rows.select(
        "conv_id",
        "speaker",
        "part",
        "slot",
        F.size("messages").cast("long").alias("n_messages"),
        F.expr(f"cast(size(filter(messages, x -> {own})) as bigint)").alias("n_own"),
        F.expr(f"array_join(transform(messages, x -> concat({head}, x.body, '{tail}')), '')").alias("text"),
        F.expr(
            f"""array_join(transform(messages, x -> concat(length({head}), ':0,',
            length(x.body) + {len(CLOSE)}, if({own}, ':1', ':0'))), ',')"""
        ).alias("mask"),
    )


def perspectives(conversations: DataFrame) -> DataFrame:
    """``conv_id, speaker, part, slot, n_messages, n_own, text, mask``.

    ``speaker`` speaks as the assistant in this row.  ``mask`` lists runs of characters of ``text`` as
    ``length:flag``, two for each message: its head, and its body with the end mark; flag 1 marks what the
    speaker said and a loss is taken on.

    System messages keep their role, and ``system`` is no participant; a dialogue without participants gives
    no rows.  A null or blank role is the speaker ``unknown``; white space in a name becomes ``_``.  A null
    text is empty.  Repeated rows count once.  Messages of one turn come by speaker and body; see
    :func:`_dealt` for crowded turns and null turns.  A message without conversation is a dialogue of its own.
    Other columns are not read.
    """
    messages = _messages(conversations)
    placed = messages.where("conv_id is not null")
    message = F.struct("turn", "speaker", "body")
    parts = _dealt(placed).groupBy("conv_id", "part", "slot").agg(F.sort_array(F.collect_set(message)).alias("messages"))
    speakers = placed.where("speaker <> 'system'").select("conv_id", "speaker").distinct()
    alone = messages.where("conv_id is null and speaker <> 'system'").distinct()
    alone = alone.select(
        "conv_id",
        F.lit(None).cast("long").alias("part"),
        F.xxhash64("speaker", "body", "turn").alias("slot"),
        F.array(message).alias("messages"),
        "speaker",
    )
    return _rendered(parts.join(speakers, "conv_id").unionByName(alone))
