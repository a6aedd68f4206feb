"""Seeded plan queries."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query
from wavelake.catalog.views import RECORDS, SOURCES, sql
from wavelake.operators import planning as P
from wavelake.operators.rules import duration_rule
from wavelake.plans.draws import derive_seed, draw, draw_dist

SEED = 12345
POOL = (
    SOURCES
    + ", pool AS (SELECT rel, category, row_number() OVER (ORDER BY category ASC NULLS LAST, rel) - 1 AS idx FROM sources), "
    "grp AS (SELECT category, min(idx) AS start, count(*) AS files, row_number() OVER (ORDER BY min(idx)) - 1 AS group_idx FROM pool GROUP BY category)"
)


def d(*parts: str) -> str:
    """SQL text of a draw."""
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


def floyd3(n: str, k: str, *parts: str) -> tuple[str, str, str]:
    """SQL columns p0, p1, p2: the first, second and third chosen index, null beyond k (k at most 3, n at least k)."""
    def r(i):
        return f"({d(*parts, '(' + i + ')')} % (({i}) + 1))"

    i = [f"({n}) - ({k}) + {s}" for s in range(3)]
    p0 = f"CASE WHEN ({k}) > 0 THEN {r(i[0])} END"
    p1 = f"CASE WHEN ({k}) > 1 THEN CASE WHEN {r(i[1])} = p0 THEN {i[1]} ELSE {r(i[1])} END END"
    p2 = f"CASE WHEN ({k}) > 2 THEN CASE WHEN {r(i[2])} IN (p0, p1) THEN {i[2]} ELSE {r(i[2])} END END"
    return p0, p1, p2


def chosen_sql(base: str, n: str, k: str, *parts: str) -> str:
    p0, p1, p2 = floyd3(n, k, *parts)
    return (
        f"c0 AS (SELECT *, {p0} AS p0 FROM {base}), c1 AS (SELECT *, {p1} AS p1 FROM c0), c2 AS (SELECT *, {p2} AS p2 FROM c1), "
        "chosen AS (SELECT *, unnest([0, 1, 2]) AS slot, unnest([p0, p1, p2]) AS pick FROM c2)"
    )


SAMPLES = RECORDS + f", smp AS (SELECT k, 1 + {d('12345', chr(39) + 'n' + chr(39), 'k')} % 3 AS n FROM records)"


def samples(t: Tables):
    return t.views.records.select("k", P.num_noises(draw(SEED, "n", F.col("k")), 1, 3).alias("n"))


@query("srt6_num_noises", sql(SAMPLES) + "SELECT k, n FROM smp")
def num_noises(t: Tables):
    return samples(t)


@query(
    "srt3_pick_any",
    sql(SAMPLES, POOL)
    + ", b AS (SELECT k, n, (SELECT count(*) FROM pool) AS files FROM smp), "
    + chosen_sql("b", "files", "n", "12345", "'any'", "k")
    + " SELECT k, CAST(slot AS BIGINT) AS slot, pick AS idx FROM chosen WHERE pick IS NOT NULL",
)
def pick_any(t: Tables):
    picks = P.pick_any(samples(t), P.noise_pool(t.views.sources), SEED)
    return picks.select("k", F.col("slot").cast("bigint").alias("slot"), "idx")


CATEGORY_PICKS = (
    ", b AS (SELECT k, n, (SELECT count(*) FROM grp) AS grps FROM smp), "
    + chosen_sql("b", "grps", "n", "12345", "'category'", "k")
    + ", picked AS (SELECT k, slot, start + " + d("12345", "'file'", "k", "group_idx") + " % files AS idx FROM chosen JOIN grp ON group_idx = pick)"
)


@query(
    "srt4_pick_distinct_categories",
    sql(SAMPLES, POOL) + CATEGORY_PICKS + " SELECT k, CAST(slot AS BIGINT) AS slot, idx FROM picked",
)
def pick_distinct_categories(t: Tables):
    picks = P.pick_distinct_categories(samples(t), P.pool_groups(P.noise_pool(t.views.sources)), SEED)
    return picks.select("k", F.col("slot").cast("bigint").alias("slot"), "idx")


@query(
    "srt4_prefer_fills_up",
    sql(SAMPLES)
    + """, pool2 AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id % 2, doc_id) - 1 AS idx FROM documents),
    g2 AS (SELECT min(idx) AS start, count(*) AS files, row_number() OVER (ORDER BY min(idx)) - 1 AS group_idx FROM pool2 GROUP BY doc_id % 2),
    b AS (SELECT k, 3 AS n, 2 AS grps, (SELECT count(*) FROM pool2) AS files FROM smp), """
    + chosen_sql("b", "grps", "least(n, 2)", "12345", "'category'", "k")
    + ", f AS (SELECT k, slot, start + " + d("12345", "'file'", "k", "group_idx") + " % g2.files AS idx FROM chosen JOIN g2 ON group_idx = pick), "
    + "tk AS (SELECT k, min(idx) AS lo, max(idx) AS hi FROM f GROUP BY k), r0 AS (SELECT b.k, lo, hi, "
    + d("12345", "'rest'", "b.k", "files - 3") + " % (files - 2) AS p FROM b JOIN tk USING (k)), r1 AS (SELECT k, hi, CASE WHEN p >= lo THEN p + 1 ELSE p END AS p FROM r0) "
    + "SELECT k, CAST(slot AS BIGINT) AS slot, idx FROM f UNION ALL SELECT k, 2, CASE WHEN p >= hi THEN p + 1 ELSE p END FROM r1",
)
def prefer_fills_up(t: Tables):
    noises = t.documents.select(
        F.format_string("%012d", "doc_id").alias("rel"), F.concat(F.lit("c"), (F.col("doc_id") % 2).cast("string")).alias("category")
    )
    groups = P.pool_groups(P.noise_pool(noises))
    picks = P.pick_distinct_categories(samples(t).withColumn("n", F.lit(3)), groups, SEED)
    return picks.select("k", F.col("slot").cast("bigint").alias("slot"), "idx")


@query(
    "srt5_pick_required",
    sql(SAMPLES, POOL)
    + """, need AS (SELECT k, n + 1 AS n FROM smp), oth AS (SELECT idx AS pool_idx, category, row_number() OVER (ORDER BY idx) - 1 AS idx FROM pool WHERE category IS DISTINCT FROM 'en'),
    og AS (SELECT min(idx) AS start, count(*) AS files, row_number() OVER (ORDER BY min(idx)) - 1 AS group_idx FROM oth GROUP BY category),
    b AS (SELECT k, n - 1 AS n, (SELECT count(*) FROM og) AS grps FROM need), """
    + chosen_sql("b", "grps", "n", "12345", "'category'", "k")
    + ", more AS (SELECT k, pool_idx AS idx FROM (SELECT k, start + " + d("12345", "'file'", "k", "group_idx")
    + " % files AS oi FROM chosen JOIN og ON group_idx = pick) x JOIN oth ON oth.idx = oi), "
    + "req AS (SELECT k, start + " + d("12345", "'file'", "k", "group_idx") + " % files AS idx FROM need CROSS JOIN grp WHERE category = 'en'), "
    + "al AS (FROM req UNION ALL FROM more) SELECT k, row_number() OVER (PARTITION BY k ORDER BY " + d("12345", "'order'", "k", "idx")
    + ", idx) - 1 AS j, idx FROM al",
)
def pick_required(t: Tables):
    rows = samples(t).withColumn("n", F.col("n") + 1)
    picks = P.pick_noises(rows, P.noise_pool(t.views.sources), SEED, "prefer_different", ["en"])
    return picks.select("k", F.col("j").cast("bigint").alias("j"), "idx")


LOW = "rejected draw"


@query(
    "srt7_first_valid_attempt",
    sql(RECORDS)
    + ", a AS (SELECT k, unnest(range(5)) AS attempt FROM records), v AS (SELECT k, attempt, " + d("12345", "k", "attempt") + " % 4 <> 0 AS ok FROM a), "
    + """w AS (SELECT k, min(attempt) FILTER (WHERE ok) AS first FROM v GROUP BY k)
    SELECT k, attempt, CASE WHEN attempt = first THEN 'won' ELSE 'rejected draw' END AS outcome FROM v JOIN w USING (k) WHERE attempt <= coalesce(first, 99)""",
)
def first_valid_attempt(t: Tables):
    def evaluate(rows):
        seed = derive_seed(SEED, F.col("k"), F.col("attempt"))
        return rows.withColumn("rejection", F.when(seed % 4 == 0, F.lit(LOW)))

    winners, failures = P.first_valid_attempt(t.views.records.select("k"), evaluate, 5)
    both = winners.withColumn("rejection", F.lit("won")).unionByName(failures)
    return both.select("k", F.col("attempt").cast("bigint").alias("attempt"), F.col("rejection").alias("outcome"))


CHUNK_ROWS = (
    RECORDS + ", need AS (SELECT k, 0 AS j, 40 + clean_source % 200 AS length, 30 + CAST(floor(duration_seconds) AS BIGINT) % 400 AS need, k % 7 AS start_sample FROM records)"
)


def chunk_rows(t: Tables):
    return t.views.records.select(
        "k",
        F.lit(0).alias("j"),
        (40 + F.col("clean_source") % 200).alias("length"),
        (30 + F.floor("duration_seconds").cast("bigint") % 400).alias("need"),
        (F.col("k") % 7).alias("start_sample"),
    )


@query(
    "sig4_plan_noise_chunks",
    sql(CHUNK_ROWS)
    + ", v AS (SELECT *, " + d("12345", "'chunk'", "k", "j") + " AS v FROM need), f AS (SELECT *, CASE WHEN length >= need THEN v % (length - need + 1) ELSE v % length END AS first FROM v), "
    + """h AS (SELECT *, least(length - first, need) AS head FROM f),
    e AS (SELECT *, unnest(range(CASE WHEN length >= need THEN 1 ELSE 1 + CAST(ceil((need - head) / length) AS BIGINT) END)) AS i FROM h),
    o AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE head + (i - 1) * length END AS off, CASE WHEN i = 0 THEN first ELSE 0 END AS src FROM e)
    SELECT k, src AS source_start_sample, src + CASE WHEN i = 0 THEN head ELSE least(length, need - off) END AS source_end_sample,
      start_sample + off AS destination_start_sample, length < need AS looped FROM o""",
)
def plan_noise_chunks(t: Tables):
    chunks = P.plan_noise_chunks(chunk_rows(t), SEED)
    return chunks.select("k", "source_start_sample", "source_end_sample", "destination_start_sample", "looped")


EVENT_SQL = (
    ", n AS (SELECT k, j, length, need AS sample_length, unnest(range(1, 2 + " + d("12345", "'events'", "k", "j") + " % 4)) AS event FROM need), "
    "s AS (SELECT *, greatest(1, least(7 + " + d("12345", "'duration'", "k", "j", "event") + " % 66, length, sample_length)) AS size FROM n), "
    "p AS (SELECT *, " + d("12345", "'source'", "k", "j", "event") + " % (length - size + 1) AS src, "
    + d("12345", "'target'", "k", "j", "event") + " % (sample_length - size + 1) AS dst FROM s) "
)


@query(
    "sig5_plan_impulsive_events",
    sql(CHUNK_ROWS) + EVENT_SQL
    + "SELECT k, event, src AS source_start_sample, src + size AS source_end_sample, dst AS destination_start_sample FROM p",
)
def plan_impulsive_events(t: Tables):
    rows = chunk_rows(t).withColumnRenamed("need", "sample_length")
    events = P.plan_impulsive_events(rows, SEED, (1, 4), (7, 72))
    return events.select("k", "event", "source_start_sample", "source_end_sample", "destination_start_sample")


@query(
    "sig6_plan_clean_crop",
    sql(CHUNK_ROWS)
    + ", v AS (SELECT k, length, " + d("12345", "'crop'", "k", "0") + " AS v FROM need) SELECT k, CASE WHEN length > 150 THEN v % (length - 149) ELSE 0 END AS clean_start_sample, "
    + "CASE WHEN length > 150 THEN v % (length - 149) + 150 ELSE length END AS clean_end_sample, length > 150 AS clean_cropped FROM v WHERE length >= 60",
)
def plan_clean_crop(t: Tables):
    rows = duration_rule(chunk_rows(t), 60, 150, draw(SEED, "crop", F.col("k"), 0))
    return rows.select("k", "clean_start_sample", "clean_end_sample", "clean_cropped")


@query("sca4_derive_seed", sql(RECORDS) + "SELECT k, " + d("12345", "k", "k % 20") + " AS seed FROM records")
def seeds(t: Tables):
    return t.views.records.select("k", derive_seed(SEED, F.col("k"), F.col("k") % 20).alias("seed"))


@query(
    "sca5_draw_dist",
    sql(RECORDS)
    + ", v AS (SELECT k, " + d("12345", "'snr'", "k") + " AS v FROM records) SELECT k, 5.0::DOUBLE AS fixed, ([-5.0, 0.0, 5.0]::DOUBLE[])[v % 3 + 1] AS choice, "
    + "round(-10 + 30 * (v / 4294967296.0::DOUBLE), 2) + 0.0 AS uniform FROM v",
)
def distributions(t: Tables):
    v = draw(SEED, "snr", F.col("k"))
    return t.views.records.select(
        "k",
        draw_dist({"type": "fixed", "value": 5}, v).alias("fixed"),
        draw_dist({"type": "choice", "values": [-5, 0, 5]}, v).alias("choice"),
        (draw_dist({"type": "uniform", "min": -10, "max": 20}, v) + F.lit(0.0)).alias("uniform"),
    )
