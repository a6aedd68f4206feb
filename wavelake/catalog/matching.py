"""Join queries."""

from pyspark.sql import functions as F

from wavelake.catalog.registry import Tables, query, rounded
from wavelake.catalog.views import RECORDS, SIG_PAIRS, SIG_SAMPLES, SOURCES, sql
from wavelake.operators import audit as A
from wavelake.operators import matching as J
from wavelake.plans.draws import derive_seed
from wavelake.plans.ordered import ordered_index

# Files of two folders whose stems overlap, some in two formats. Conditions on ids decide which files exist on which
# side; every row of the table takes part in the query.
FILE_SQL = (
    "cf AS (SELECT concat('clean/', doc_id, CASE WHEN doc_id % 3 = 0 THEN '.mp3' ELSE '.wav' END) AS path, CAST(doc_id AS VARCHAR) AS stem FROM documents "
    "UNION ALL SELECT concat('clean/', doc_id, '.wav'), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 6 = 0), "
    "ef AS (SELECT concat('est/', doc_id, '.wav') AS path, CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id % 5 <> 0 "
    "UNION ALL SELECT concat('est/', doc_id, '.mp3'), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 2 = 0)"
)
FIRST = "CASE WHEN count(*) FILTER (WHERE path LIKE '%.wav') > 0 THEN min(path) FILTER (WHERE path LIKE '%.wav') ELSE min(path) END"


def _doc_files(t: Tables, folder: str, condition: str, ext):
    doc = F.col("doc_id").cast("string")
    return t.documents.where(condition).select(F.concat(F.lit(folder + "/"), doc, ext).alias("path"))


def clean_files(t: Tables):
    mixed = _doc_files(t, "clean", "true", F.when(F.col("doc_id") % 3 == 0, ".mp3").otherwise(".wav"))
    return mixed.union(_doc_files(t, "clean", "doc_id % 6 = 0", F.lit(".wav")))


def estimate_files(t: Tables):
    return _doc_files(t, "est", "doc_id % 5 <> 0", F.lit(".wav")).union(_doc_files(t, "est", "doc_id % 2 = 0", F.lit(".mp3")))


@query(
    "jn1_pair_by_stem",
    "WITH " + FILE_SQL
    + f", c AS (SELECT stem, {FIRST} AS clean_path FROM cf GROUP BY stem), e AS (SELECT stem, {FIRST} AS estimate_path FROM ef GROUP BY stem) "
    + "SELECT stem, clean_path, estimate_path FROM c JOIN e USING (stem)",
)
def pair_by_stem(t: Tables):
    return J.pair_by_stem(clean_files(t), estimate_files(t))


STAGE_SQL = (
    ", sf AS (SELECT 'noisy' AS stage, concat('noisy/', doc_id, '.wav') AS path, CAST(doc_id AS VARCHAR) AS stem FROM documents WHERE doc_id % 7 <> 0 "
    "UNION ALL SELECT 'enhanced', concat('enhanced/', doc_id, '.wav'), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 4 <> 1 "
    "UNION ALL SELECT 'final', concat('final/', doc_id, '.mp3'), CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 5 <> 2)"
)
STAGES = ["noisy", "enhanced", "final"]


def stage_files(t: Tables):
    rules = {"noisy": ("doc_id % 7 <> 0", ".wav"), "enhanced": ("doc_id % 4 <> 1", ".wav"), "final": ("doc_id % 5 <> 2", ".mp3")}
    parts = [_doc_files(t, s, c, F.lit(e)).withColumn("stage", F.lit(s)) for s, (c, e) in rules.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "jn2_match_all_stages",
    "WITH " + FILE_SQL + STAGE_SQL
    + """, ok AS (SELECT stem FROM sf GROUP BY stem HAVING count(DISTINCT stage) = 3)
    SELECT stem, stage, path FROM sf WHERE stem IN (FROM ok) AND stem IN (SELECT stem FROM cf)""",
)
def match_all_stages(t: Tables):
    return J.match_all_stages(clean_files(t), stage_files(t), STAGES)


@query(
    "jn9_skip_report",
    "WITH " + FILE_SQL + STAGE_SQL
    + """, c AS (SELECT DISTINCT stem FROM cf), s AS (SELECT * FROM (VALUES (0, 'noisy'), (1, 'enhanced'), (2, 'final')) v(o, stage)),
    m AS (SELECT c.stem, o, s.stage FROM c CROSS JOIN s ANTI JOIN sf ON sf.stem = c.stem AND sf.stage = s.stage)
    SELECT stem, string_agg(stage, ',' ORDER BY o) AS missing FROM m GROUP BY stem""",
)
def skip_report(t: Tables):
    report = J.skip_report(clean_files(t), stage_files(t), STAGES)
    return report.select("stem", F.array_join("missing", ",").alias("missing"))


@query(
    "jn3_apply_sidecar",
    sql(SOURCES)
    + """, side AS (SELECT concat('wav/', source, '/', lang, '/', doc_id, '.wav') AS rel, CASE WHEN doc_id % 2 = 0 THEN concat('cat', doc_id % 5) END AS category,
      CASE WHEN doc_id % 3 = 0 THEN 'set-a' END AS noise_dataset FROM documents WHERE doc_id % 4 < 2)
    SELECT rel, coalesce(side.category, sources.category) AS noise_category, coalesce(side.noise_dataset, 'base') AS noise_dataset
    FROM sources LEFT JOIN side USING (rel)""",
)
def apply_sidecar(t: Tables):
    sources = t.views.sources
    doc = F.col("doc_id")
    side = sources.where("doc_id % 4 < 2").select(
        F.col("rel").alias("path"),
        F.when(doc % 2 == 0, F.concat(F.lit("cat"), (doc % 5).cast("string"))).alias("noise_category"),
        F.when(doc % 3 == 0, "set-a").alias("noise_dataset"),
    )
    inferred = sources.select("rel", F.col("category").alias("noise_category"), F.lit("base").alias("noise_dataset"))
    return J.apply_sidecar(inferred, side, ["noise_category", "noise_dataset"]).select("rel", "noise_category", "noise_dataset")


@query(
    "jn5_membership",
    """SELECT o_orderkey AS k, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 7) AS is_frozen,
    o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) AS is_calibration FROM orders""",
)
def membership(t: Tables):
    ids = t.lineitem.withColumnRenamed("l_orderkey", "k")
    rows = J.mark_members(t.orders.select(F.col("o_orderkey").alias("k")), ids.where("l_linenumber = 7"), "k", "is_frozen")
    return J.mark_members(rows, ids.where("l_quantity > 49"), "k", "is_calibration")


@query(
    "jn6_todo",
    sql(RECORDS)
    + """, done AS (SELECT k, CASE WHEN k % 50 = 0 THEN 'test' ELSE split END AS split FROM records WHERE k % 3 <> 0
      UNION ALL SELECT k + 10000000, split FROM records WHERE k % 1000 = 1)
    SELECT k AS sample_id, 'todo' AS kind FROM records WHERE k NOT IN (SELECT k FROM done) UNION ALL
    SELECT done.k, 'misfit' FROM done LEFT JOIN records USING (k) WHERE done.split IS DISTINCT FROM records.split""",
)
def todo(t: Tables):
    plan = t.views.records.select(F.col("k").alias("sample_id"), "split")
    k = F.col("sample_id")
    done = plan.where(k % 3 != 0).withColumn("split", F.when(k % 50 == 0, "test").otherwise(F.col("split")))
    done = done.union(plan.where(k % 1000 == 1).select((k + 10000000).alias("sample_id"), "split"))
    left = J.todo(plan, done).select("sample_id", F.lit("todo").alias("kind"))
    return left.union(J.misfits(plan, done).select("sample_id", F.lit("misfit").alias("kind")))


# Records with two output paths each, and files on disk that differ from them in both directions.
OUTPUT_SQL = (
    ", rec AS (SELECT k, CAST(k AS VARCHAR) AS sample_id, concat(split, '/clean/', k, '.wav') AS clean_output, "
    "concat(split, '/noisy/', CASE WHEN k % 500 = 0 THEN concat('x', k) ELSE CAST(k AS VARCHAR) END, '.wav') AS noisy_output FROM records WHERE k % 4 <> 0 "
    "UNION ALL SELECT k, CAST(k AS VARCHAR), concat(split, '/clean/', k, '.wav'), concat(split, '/noisy/', k, '.wav') FROM records WHERE k % 999 = 1), "
    "disk AS (SELECT 'clean' AS kind, concat(split, '/clean/', k, '.wav') AS path FROM records WHERE k % 5 <> 0 "
    "UNION ALL SELECT 'noisy', concat(split, '/noisy/', k, '.wav') FROM records WHERE k % 6 <> 0)"
)


def outputs(t: Tables):
    k, text = F.col("k"), F.col("k").cast("string")
    clean = F.concat("split", F.lit("/clean/"), text, F.lit(".wav")).alias("clean_output")

    def noisy(name):
        return F.concat("split", F.lit("/noisy/"), name, F.lit(".wav")).alias("noisy_output")

    odd = F.when(k % 500 == 0, F.concat(F.lit("x"), text)).otherwise(text)
    records = t.views.records
    first = records.where("k % 4 <> 0").select(text.alias("sample_id"), clean, noisy(odd))
    recs = first.union(records.where("k % 999 = 1").select(text.alias("sample_id"), clean, noisy(text)))
    files = records.where("k % 5 <> 0").select(F.lit("clean").alias("kind"), clean.alias("path")).union(
        records.where("k % 6 <> 0").select(F.lit("noisy").alias("kind"), noisy(text).alias("path"))
    )
    return recs, files


@query(
    "jn7_verify_output",
    sql(RECORDS) + OUTPUT_SQL
    + """, c AS (SELECT count(*) AS n FROM (SELECT DISTINCT clean_output AS p FROM rec) a FULL JOIN (SELECT DISTINCT path AS p FROM disk WHERE kind = 'clean') b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL),
    n AS (SELECT count(*) AS n FROM (SELECT DISTINCT noisy_output AS p FROM rec) a FULL JOIN (SELECT DISTINCT path AS p FROM disk WHERE kind = 'noisy') b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL)
    SELECT (SELECT count(*) FROM rec) AS metadata_records, (SELECT count(*) FROM (SELECT sample_id FROM rec GROUP BY 1 HAVING count(*) > 1)) AS duplicate_ids,
      (SELECT count(*) FROM rec WHERE noisy_output NOT LIKE concat('%/', sample_id, '.wav')) AS name_mismatches,
      (SELECT count(*) FROM disk WHERE kind = 'clean') AS clean_files, (SELECT count(*) FROM disk WHERE kind = 'noisy') AS noisy_files,
      (SELECT n FROM c) AS clean_mismatches, (SELECT n FROM n) AS noisy_mismatches, false AS one_to_one""",
)
def verify_output(t: Tables):
    return J.verify_output(*outputs(t))


@query(
    "jn8_orphans_missing",
    sql(RECORDS) + OUTPUT_SQL
    + """, o AS (SELECT clean_output AS path FROM rec UNION ALL SELECT noisy_output FROM rec)
    SELECT 'orphan' AS kind, path FROM disk WHERE path NOT IN (FROM o) UNION ALL SELECT 'missing', path FROM o WHERE path NOT IN (SELECT path FROM disk)""",
)
def orphans_missing(t: Tables):
    recs, files = outputs(t)
    orphans = J.orphans(recs, files).select(F.lit("orphan").alias("kind"), "path")
    return orphans.union(J.missing(recs, files).select(F.lit("missing").alias("kind"), "path"))


@query(
    "jn10_locate",
    sql(SOURCES)
    + """, w AS (SELECT DISTINCT concat('mixtures/', rel) AS relpath, rel, doc_id FROM sources)
    SELECT relpath, CASE WHEN doc_id % 3 = 0 THEN concat('/b/', relpath) WHEN doc_id % 5 = 0 THEN concat('/a/', relpath)
      WHEN doc_id % 2 = 0 THEN concat('zip:', rel) END AS location FROM w""",
)
def locate(t: Tables):
    rows = t.views.sources.select("doc_id", "rel", F.concat(F.lit("mixtures/"), "rel").alias("relpath"))
    first = rows.where("doc_id % 3 = 0").select(F.lit(0).alias("root_ord"), F.lit("/b").alias("root"), "relpath")
    second = rows.where("doc_id % 5 = 0").select(F.lit(1).alias("root_ord"), F.lit("/a").alias("root"), "relpath")
    members = rows.where("doc_id % 2 = 0").select((F.col("doc_id") % 4).alias("archive_ord"), F.col("rel").alias("member"))
    return J.locate(rows, first.union(second), members)


REGION_SQL = (
    ", reg AS (SELECT signal_id, t AS start_sample, t + 4 + t % 5 AS end_sample FROM {0} WHERE t % 9 = 2 OR t % 21 = 5)"
)


def view_regions(samples):
    t = F.col("t")
    return samples.where((t % 9 == 2) | (t % 21 == 5)).select(
        "signal_id", t.alias("start_sample"), (t + 4 + t % 5).alias("end_sample")
    )


@query(
    "jn11_mask_from_regions",
    sql(SIG_SAMPLES) + REGION_SQL.format("sig_samples")
    + """SELECT signal_id, t, EXISTS (SELECT 1 FROM reg r WHERE r.signal_id = s.signal_id AND s.t >= r.start_sample AND s.t < r.end_sample) AS mask FROM sig_samples s""",
)
def mask_from_regions(t: Tables):
    samples = t.views.sig_samples
    return J.mask_from_regions(samples, view_regions(samples), ["signal_id"]).select("signal_id", "t", "mask")


# Segments of all signals, from anywhere in them: four picks for each sample.
PLAN_SQL = (
    ", ln AS (SELECT signal_id, count(*) AS len, row_number() OVER (ORDER BY signal_id) - 1 AS idx FROM sig_samples GROUP BY signal_id), "
    "plan AS (SELECT k // 4 AS sample_id, k % 4 AS pick, signal_id AS source, k * 31 % greatest(len - 5, 1) AS a, k * 31 % greatest(len - 5, 1) + 5 + k % 23 AS b, k % 31 AS d "
    "FROM records JOIN ln ON idx = k * 7919 % (SELECT count(*) FROM ln))"
)
PLACED_SQL = PLAN_SQL + ", placed AS (SELECT sample_id, pick, t - a + d AS t, x FROM plan JOIN sig_samples ON signal_id = source AND t >= a AND t < b)"


def placement_plan(t: Tables):
    k = F.col("k")
    lengths = t.views.sig_samples.groupBy("signal_id").agg(F.count(F.lit(1)).alias("len"))
    signals = ordered_index(lengths, ["signal_id"], "idx")
    drawn = J.draw_by_index(t.views.records.select("k", (k * 7919).alias("draw")), signals, "draw")
    start = k * 31 % F.greatest(F.col("len") - 5, F.lit(1))
    return drawn.select(
        F.floor(k / 4).alias("sample_id"),
        (k % 4).alias("pick"),
        F.col("signal_id").alias("source"),
        start.alias("source_start_sample"),
        (start + 5 + k % 23).alias("source_end_sample"),
        (k % 31).alias("destination_start_sample"),
    )


@query(
    "jn12_place_segments",
    sql(RECORDS, SIG_SAMPLES) + PLACED_SQL + "SELECT sample_id, pick, t, round(x, 6) + 0.0 AS x FROM placed",
)
def place_segments(t: Tables):
    source = t.views.sig_samples.select(F.col("signal_id").alias("source"), "t", "x")
    placed = J.place_segments(source, placement_plan(t))
    return placed.select("sample_id", "pick", "t", rounded(F.col("x")).alias("x"))


@query(
    "agg26_overlay_sum",
    sql(RECORDS, SIG_SAMPLES) + PLACED_SQL
    + "SELECT sample_id, t, round(sum(x * (1 + pick) / 2), 6) + 0.0 AS x FROM placed GROUP BY sample_id, t",
)
def overlay_sum(t: Tables):
    from wavelake.operators.signals import overlay_sum as overlay

    source = t.views.sig_samples.select(F.col("signal_id").alias("source"), "t", "x")
    placed = J.place_segments(source, placement_plan(t)).withColumn("gain", (1 + F.col("pick")) / 2)
    return overlay(placed).select("sample_id", "t", rounded(F.col("x")).alias("x"))


@query(
    "jn14_verify_checksums",
    """SELECT concat('doc/', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 'MISSING' WHEN doc_id % 13 = 0 THEN 'HASH MISMATCH' ELSE 'OK' END AS status FROM documents""",
)
def verify_checksums(t: Tables):
    doc = F.col("doc_id")
    path = F.concat(F.lit("doc/"), doc.cast("string")).alias("path")
    text = F.when(doc % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    manifest = t.documents.select(path, F.sha2(text, 256).alias("sha256"))
    files = t.documents.where(doc % 5 != 0).select(path, F.col("text").cast("binary").alias("content"))
    return J.verify_checksums(manifest, files)


@query(
    "jn15_category_coverage",
    sql(SOURCES)
    + """, c AS (SELECT category, count(*) AS n FROM sources GROUP BY category)
    SELECT * FROM (
      SELECT 'error' AS severity, 'missing required' AS issue, 'xx' AS detail UNION ALL
      SELECT 'error', 'too few categories', CAST(count(*) FILTER (WHERE category IS DISTINCT FROM 'en') AS VARCHAR) FROM c HAVING count(*) FILTER (WHERE category IS DISTINCT FROM 'en') < 8 UNION ALL
      SELECT 'warning', 'unmatched impulsive', 'boom')""",
)
def category_coverage(t: Tables):
    return J.category_coverage(["en", "xx"], ["boom", "en"], t.views.sources, "require_different", 10)


@query(
    "jn16_skip_converted",
    "WITH " + FILE_SQL
    + """, o AS (SELECT path, stem, CAST(stem AS BIGINT) % 4 AS size FROM ef) SELECT path FROM cf WHERE stem NOT IN (SELECT stem FROM o WHERE size > 0)""",
)
def skip_converted(t: Tables):
    from wavelake.functions.scalars import stem

    outputs_ = estimate_files(t).withColumn("size", stem(F.col("path")).cast("bigint") % 4)
    return J.skip_converted(clean_files(t), outputs_)


@query(
    "jn17_attach_reference",
    """SELECT concat(doc_id, '.wav') AS name, CASE WHEN doc_id % 3 <> 0 THEN concat('ref/', doc_id, '.wav') END AS reference_path,
    doc_id % 3 = 0 OR doc_id % 7 <> 0 AS accepted FROM documents""",
)
def attach_reference(t: Tables):
    doc = F.col("doc_id")
    name = F.concat(doc.cast("string"), F.lit(".wav"))
    primary = t.documents.select(name.alias("name"), F.col("n_chars").alias("frames"))
    reference = t.documents.where(doc % 3 != 0).select(
        name.alias("name"),
        F.concat(F.lit("ref/"), name).alias("path"),
        (F.col("n_chars") + F.when(doc % 7 == 0, 1).otherwise(0)).alias("frames"),
    )
    return J.attach_reference(primary, reference).select("name", "reference_path", "accepted")


@query(
    "jn18_draw_by_index",
    sql(RECORDS, SOURCES)
    + """, pool AS (SELECT rel, row_number() OVER (ORDER BY rel) - 1 AS idx FROM sources), n AS (SELECT count(*) AS n FROM pool),
    d AS (SELECT k, ('0x' || substr(md5(concat_ws(':', 12345, k, 0)), 1, 8))::BIGINT AS draw FROM records)
    SELECT k, draw AS seed, rel FROM d JOIN pool ON pool.idx = draw % (SELECT n FROM n)""",
)
def draw_by_index(t: Tables):
    pool = ordered_index(t.views.sources.select("rel"), ["rel"])
    samples = t.views.records.select("k", derive_seed(12345, F.col("k"), 0).alias("seed"))
    return J.draw_by_index(samples, pool, "seed").select("k", "seed", "rel")


@query(
    "set1_union_manifests",
    sql(RECORDS)
    + """SELECT k AS mixture_id, split, target_snr_db > 20 AS loud, NULL AS status FROM records WHERE split = 'train'
    UNION ALL SELECT k, split, NULL, CASE WHEN k % 20 = 0 THEN 'PASS' ELSE 'FAIL' END FROM records WHERE split = 'val'""",
)
def union_manifests(t: Tables):
    records = t.views.records.withColumnRenamed("k", "mixture_id")
    train = records.where("split = 'train'").select("mixture_id", "split", (F.col("target_snr_db") > 20).alias("loud"))
    status = F.when(F.col("mixture_id") % 20 == 0, "PASS").otherwise("FAIL").alias("status")
    return A.union_manifests([train, records.where("split = 'val'").select("mixture_id", "split", status)])


@query(
    "set2_symmetric_difference",
    sql(RECORDS) + OUTPUT_SQL
    + """, e AS (SELECT DISTINCT clean_output AS path FROM rec), d AS (SELECT DISTINCT path FROM disk WHERE kind = 'clean')
    SELECT path, 'left' AS side FROM (FROM e EXCEPT FROM d) UNION ALL SELECT path, 'right' FROM (FROM d EXCEPT FROM e)""",
)
def symmetric_difference(t: Tables):
    recs, files = outputs(t)
    return A.symmetric_difference(recs.select(F.col("clean_output").alias("path")), files.where("kind = 'clean'").select("path"))


@query(
    "set3_leakage",
    sql(RECORDS)
    + """, tr AS (SELECT k AS mixture_id, concat(CASE WHEN k % 400 = 1 THEN 'mixtures/fast/' ELSE 'mixtures/val/' END, k) AS noisy_relpath FROM records WHERE split = 'train' OR k % 700 = 0),
    va AS (SELECT k AS mixture_id FROM records WHERE split = 'val')
    SELECT 'overlap' AS issue, CAST(mixture_id AS VARCHAR) AS detail FROM (SELECT mixture_id FROM tr INTERSECT SELECT mixture_id FROM va)
    UNION ALL SELECT 'forbidden path', noisy_relpath FROM tr WHERE starts_with(noisy_relpath, 'mixtures/fast')""",
)
def leakage(t: Tables):
    k = F.col("k")
    path = F.concat(F.when(k % 400 == 1, "mixtures/fast/").otherwise("mixtures/val/"), k.cast("string"))
    train = t.views.records.where("split = 'train' OR k % 700 = 0").select(k.alias("mixture_id"), path.alias("noisy_relpath"))
    return A.leakage(train, t.views.records.where("split = 'val'").select(k.alias("mixture_id")), "mixtures/fast")


@query(
    "set4_frozen_union",
    """SELECT l_orderkey AS mixture_id FROM lineitem WHERE l_linenumber = 7 UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49""",
)
def frozen_union(t: Tables):
    ids = t.lineitem.withColumnRenamed("l_orderkey", "mixture_id")
    return A.frozen_union([ids.where("l_linenumber = 7"), ids.where("l_quantity > 49")])


@query(
    "set5_releasable_sources",
    """SELECT l_partkey AS source, max(l_orderkey) AS last_sample_id FROM lineitem LEFT JOIN (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 10 > 0) r
    ON o_orderkey = l_orderkey GROUP BY l_partkey HAVING count(*) FILTER (WHERE o_orderkey IS NULL) = 0""",
)
def releasable_sources(t: Tables):
    plan = t.lineitem.select(F.col("l_orderkey").alias("sample_id"), F.col("l_partkey").alias("source"))
    resolved = t.orders.where("o_orderstatus <> 'P' OR o_orderkey % 10 > 0").select(F.col("o_orderkey").alias("sample_id"))
    return A.releasable_sources(plan, resolved)


@query(
    "agg29_active_fraction",
    sql(SIG_PAIRS) + REGION_SQL.format("sig_pairs")
    + """, m AS (SELECT signal_id, EXISTS (SELECT 1 FROM reg r WHERE r.signal_id = s.signal_id AND s.t >= r.start_sample AND s.t < r.end_sample) AS mask FROM sig_pairs s)
    SELECT signal_id, round(avg(CAST(mask AS INTEGER)), 4) + 0.0 AS active_fraction FROM m GROUP BY signal_id""",
)
def active_fraction(t: Tables):
    samples = t.views.sig_pairs
    masked = J.mask_from_regions(samples, view_regions(samples), ["signal_id"])
    return masked.groupBy("signal_id").agg(rounded(F.avg(F.col("mask").cast("int")), 4).alias("active_fraction"))
