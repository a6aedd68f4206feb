"""Rotating a dialogue of several parties through every speaker's perspective. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns in one row of output at most, unless turns share a number.
CHUNK_TURNS = 256


def rotate_perspectives(turns: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """(conv_id, speaker, chunk, n_turns, n_target_turns, rendered, mask): one dialogue for every participant.

    ``turns`` has conv_id, turn, role, text. Every role except ``system`` is a participant. In the row of a speaker,
    its turns carry the header ``assistant``, system turns ``system`` and those of the others ``user NAME``; each turn
    is ``<|im_start|>HEADER\\nTEXT<|im_end|>\\n``. ``mask`` lists the [start, end) code point ranges of ``rendered``
    to train on: text and end mark of the speaker's own turns. A conversation without participants gives no rows.

    A conversation of any length is cut into chunks by turn number (``turn div chunk_turns``; null turns come last, as
    chunk null), so no task gathers a whole long conversation; the chunks in order are the dialogue and every chunk is
    rendered for all participants of the conversation. Turns that share a number keep the order of role, then text.
    Null texts render as empty; a null role is the participant ``unknown``; null conv_id is a conversation of its own.
    Other columns are ignored. An empty table gives an empty result.
    """
    named = turns.select(
        "conv_id",
        "turn",
        F.floor(F.col("turn") / chunk_turns).alias("chunk"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The speakers of a conversation: names only, combined before the shuffle.
    speakers = (
        named.where("role != 'system'").groupBy("conv_id").agg(F.sort_array(F.collect_set("role")).alias("speakers"))
    )
    said = F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text")
    chunks = named.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(said)).alias("said"))
    rotated = (
        chunks.alias("c")
        .join(speakers.alias("s"), F.col("c.conv_id").eqNullSafe(F.col("s.conv_id")))
        .select("c.conv_id", "c.chunk", "c.said", F.explode("s.speakers").alias("speaker"))
    )

    def part(x, speaker):
        header = F.when(x["role"] == speaker, "assistant").when(x["role"] == "system", "system")
        header = F.coalesce(header, F.concat(F.lit("user "), x["role"]))
        head = F.concat(F.lit("<|im_start|>"), header, F.lit("\n"))
        return F.struct(
            (x["role"] == speaker).alias("own"),
            F.length(head).alias("skip"),
            F.concat(head, x["text"], F.lit("<|im_end|>\n")).alias("piece"),
        )

    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"])).alias("at"),
        F.when(
            x["own"],
            F.concat(
                acc["mask"],
                F.array(
                    F.struct(
                        (acc["at"] + x["skip"]).alias("start"), (acc["at"] + F.length(x["piece"]) - 1).alias("end")
                    )
                ),
            ),
        )
        .otherwise(acc["mask"])
        .alias("mask"),
    )
    start = F.struct(
        F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("mask")
    )
    return (
        rotated.withColumn("parts", F.transform("said", lambda x: part(x, F.col("speaker"))))
        .select(
            "conv_id",
            "speaker",
            "chunk",
            F.size("said").cast("long").alias("n_turns"),
            F.size(F.filter("parts", lambda x: x["own"])).cast("long").alias("n_target_turns"),
            F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("rendered"),
            F.aggregate("parts", start, step, lambda acc: acc["mask"]).alias("mask"),
        )
    )


def mask_text(mask: Column) -> Column:
    """The mask as text, ``start:end`` joined by commas."""
    return F.array_join(F.transform(mask, lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ",")


#: DuckDB SQL for the rows of ``rotate_perspectives`` with the mask as text.
SQL = """
WITH named AS (
  SELECT conv_id, turn, CAST(floor(turn / 256) AS BIGINT) AS chunk, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), speakers AS (
  SELECT DISTINCT conv_id, role AS speaker FROM named WHERE role != 'system'
), pieces AS (
  SELECT n.conv_id, s.speaker, n.chunk, n.turn, n.role, n.text, n.role = s.speaker AS own,
    '<|im_start|>' || CASE WHEN n.role = s.speaker THEN 'assistant' WHEN n.role = 'system' THEN 'system'
      ELSE 'user ' || n.role END || chr(10) AS head
  FROM named n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
), placed AS (
  SELECT *, row_number() OVER w AS k,
    sum(length(head) + length(text) + 11) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM pieces WINDOW w AS (PARTITION BY conv_id, speaker, chunk ORDER BY turn NULLS LAST, role, text)
)
SELECT conv_id, speaker, chunk, count(*) AS n_turns, count(*) FILTER (own) AS n_target_turns,
  string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered,
  coalesce(string_agg((upto - length(text) - 11) || ':' || (upto - 1), ',' ORDER BY k) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, speaker, chunk
"""
