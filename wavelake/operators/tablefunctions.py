"""Range planners as SQL table functions, for use with LATERAL. They are plain SQL, so a call becomes part of the query's
own plan: one row generator inside its compiled code, and no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Source ranges that cover ``need`` samples from ``first`` on, starting over at 0 when the source ends.
LOOP_CHUNKS = """
CREATE OR REPLACE TEMPORARY FUNCTION loop_chunks(length BIGINT, need BIGINT, first BIGINT)
RETURNS TABLE (source_start_sample BIGINT, source_end_sample BIGINT, destination_start_sample BIGINT)
RETURN SELECT c.a, c.b, c.d FROM explode(transform(
  CASE WHEN need > 0 AND length > 0 THEN sequence(0L, CAST(ceil((need - least(length - first, need)) / length) AS BIGINT))
    ELSE CAST(array() AS ARRAY<BIGINT>) END,
  i -> CASE WHEN i = 0 THEN named_struct('a', first, 'b', first + least(length - first, need), 'd', 0L)
    ELSE named_struct('a', 0L, 'b', least(length, need - least(length - first, need) - (i - 1) * length),
      'd', least(length - first, need) + (i - 1) * length) END)) AS t(c)
"""

#: Full frames of a signal; a signal shorter than a frame is one short frame.
FRAME_RANGES = """
CREATE OR REPLACE TEMPORARY FUNCTION frame_ranges(samples BIGINT, length BIGINT, hop BIGINT)
RETURNS TABLE (frame BIGINT, start_sample BIGINT, end_sample BIGINT)
RETURN SELECT c.f, c.a, c.b FROM explode(transform(
  CASE WHEN samples > 0 THEN sequence(0L, greatest(samples - length, 0L) div hop) ELSE CAST(array() AS ARRAY<BIGINT>) END,
  i -> named_struct('f', i, 'a', i * hop, 'b', i * hop + least(length, samples)))) AS t(c)
"""

#: Events from three draws each: duration, source start, target start.
IMPULSIVE_EVENTS = """
CREATE OR REPLACE TEMPORARY FUNCTION impulsive_events(length BIGINT, samples BIGINT, low BIGINT, high BIGINT, draws ARRAY<BIGINT>)
RETURNS TABLE (event BIGINT, source_start_sample BIGINT, source_end_sample BIGINT, destination_start_sample BIGINT)
RETURN SELECT c.e, c.s % (length - c.n + 1), c.s % (length - c.n + 1) + c.n, c.t % (samples - c.n + 1) FROM explode(transform(
  CASE WHEN size(draws) >= 3 THEN sequence(0, size(draws) div 3 - 1) ELSE CAST(array() AS ARRAY<BIGINT>) END,
  i -> named_struct('e', CAST(i + 1 AS BIGINT),
    'n', greatest(1L, least(low + draws[CAST(3 * i AS INT)] % (high - low + 1), length, samples)),
    's', draws[CAST(3 * i + 1 AS INT)], 't', draws[CAST(3 * i + 2 AS INT)]))) AS t(c)
"""


def register_table_functions(spark: SparkSession) -> None:
    """``loop_chunks``, ``frame_ranges`` and ``impulsive_events`` for this session."""
    for function in (LOOP_CHUNKS, FRAME_RANGES, IMPULSIVE_EVENTS):
        spark.sql(function)
