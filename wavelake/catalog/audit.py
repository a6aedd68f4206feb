"""Audit roll-ups over records and inventories."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import RECORD_NOISES, RECORDS, SOURCES, sql
from wavelake.operators import audit as A


@query(
    "agg1_usage_counts",
    sql(RECORDS, RECORD_NOISES)
    + """, u AS (SELECT 'clean_source' AS kind, CAST(clean_source AS VARCHAR) AS name FROM records UNION ALL
      SELECT 'noise_source', CAST(source AS VARCHAR) FROM record_noises UNION ALL SELECT 'noise_category', coalesce(category, 'null') FROM record_noises)
    SELECT kind, name, count(*) AS uses FROM u GROUP BY kind, name""",
)
def usage_counts(t: Tables):
    return A.usage_counts(t.views.records, t.views.record_noises)


SNR_STATS = {
    "snr_min": "min(measured_snr_db)", "snr_max": "max(measured_snr_db)", "snr_mean": "avg(measured_snr_db)",
    "target_snr_min": "min(target_snr_db)", "target_snr_max": "max(target_snr_db)", "target_snr_mean": "avg(target_snr_db)",
    "snr_error_mean_db": "avg(measured_snr_db - target_snr_db)", "snr_error_max_abs_db": "max(abs(measured_snr_db - target_snr_db))",
}


@query("agg2_snr_stats", sql(RECORDS) + "SELECT " + ", ".join(f"round({e}, 4) + 0.0 AS {n}" for n, e in SNR_STATS.items()) + " FROM records")
def snr_stats(t: Tables):
    stats = A.snr_stats(t.views.records)
    return stats.select(*[(F.col(c) + F.lit(0.0)).alias(c) for c in stats.columns])


@query(
    "agg3_snr_histogram",
    sql(RECORDS)
    + """, b AS (SELECT floor(measured_snr_db / 5) * 5 AS lower FROM records)
    SELECT lower, concat(CAST(lower AS BIGINT), '_to_', CAST(lower + 5 AS BIGINT)) AS label, count(*) AS samples FROM b GROUP BY lower""",
)
def snr_histogram(t: Tables):
    return A.snr_histogram(t.views.records)


@query(
    "agg4_distinct_counts",
    sql(RECORDS, RECORD_NOISES, SOURCES)
    + """SELECT (SELECT count(DISTINCT clean_source) FROM records) AS clean_sources_used, (SELECT count(DISTINCT clean_source % 40) FROM records) AS clean_speakers,
    (SELECT count(DISTINCT source) FROM record_noises) AS noise_sources_used, (SELECT count(DISTINCT category) FROM record_noises) AS noise_categories_used,
    (SELECT count(*) FROM sources) AS sources, (SELECT count(DISTINCT category) FROM sources) AS noise_categories""",
)
def distinct_counts(t: Tables):
    records = t.views.records.withColumn("clean_speaker_id", F.col("clean_source") % 40)
    return A.distinct_counts(records, t.views.record_noises, t.views.sources)


@query(
    "agg5_conditional_counts",
    sql(RECORDS, RECORD_NOISES)
    + """SELECT (SELECT count(*) FROM records WHERE clipping_prevented) AS clipping_gain_samples,
    (SELECT count(*) FROM record_noises WHERE n_events = 0 AND looped) AS looped_noises, (SELECT CAST(sum(n_events) AS BIGINT) FROM record_noises) AS impulsive_events""",
)
def conditional_counts(t: Tables):
    looped = F.when(F.col("n_events") == 0, F.col("looped"))
    return A.conditional_counts(t.views.records, t.views.record_noises.withColumn("looped", looped))


@query(
    "agg6_split_totals",
    sql(RECORDS) + "SELECT split, count(*) AS samples, round(sum(duration_seconds) / 3600, 4) + 0.0 AS hours FROM records GROUP BY split",
)
def split_totals(t: Tables):
    return A.split_totals(t.views.records)


@query(
    "agg6_noise_count_distribution",
    sql(RECORD_NOISES)
    + "SELECT num_noises, count(*) AS samples FROM (SELECT k, count(*) AS num_noises FROM record_noises GROUP BY k) GROUP BY num_noises",
)
def noise_count_distribution(t: Tables):
    return A.noise_count_distribution(t.views.record_noises)


@query(
    "agg20_inventory_hash",
    sql(SOURCES)
    + """, l AS (SELECT 0 AS o, rel, size FROM sources UNION ALL SELECT 1, replace(rel, 'wav/', 'noise/'), size + 7 FROM sources WHERE category IS NOT NULL),
    i AS (SELECT sha256(concat(rel, '|', size, chr(10))) AS digest, row_number() OVER (ORDER BY o, rel) - 1 AS idx FROM l),
    c AS (SELECT idx // 4096 AS chunk, sha256(string_agg(digest, '' ORDER BY idx)) AS digest, count(*) AS n FROM i GROUP BY 1)
    SELECT CASE WHEN count(*) = 1 THEN max(digest) ELSE sha256(string_agg(digest, '' ORDER BY chunk)) END AS inventory_hash, CAST(sum(n) AS BIGINT) AS sources FROM c""",
)
def inventory_hash(t: Tables):
    sources = t.views.sources
    noise = sources.where("category IS NOT NULL").select(
        F.lit(1).alias("kind_ord"), F.regexp_replace("rel", "^wav/", "noise/").alias("rel"), (F.col("size") + 7).alias("size")
    )
    return A.inventory_hash(sources.select(F.lit(0).alias("kind_ord"), "rel", "size").union(noise))


@query(
    "agg27_group_by_category",
    sql(SOURCES)
    + """, g AS (SELECT category, count(*) AS files, row_number() OVER (ORDER BY category ASC NULLS LAST) - 1 AS category_idx FROM sources GROUP BY category)
    SELECT s.category, category_idx, files, rel, row_number() OVER (PARTITION BY category_idx ORDER BY rel) - 1 AS idx
    FROM sources s JOIN g ON g.category IS NOT DISTINCT FROM s.category""",
)
def group_by_category(t: Tables):
    groups, members = A.category_groups(t.views.sources), A.category_members(t.views.sources)
    groups = groups.withColumnRenamed("category", "group_name")
    joined = members.join(groups, F.col("group_name").eqNullSafe(F.col("category")))
    return joined.select("category", "category_idx", "files", "rel", "idx")
