"""Profiles, duplicates, contamination and leakage over the image pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import scalars as S
from gleanery.functions.names import alias_table, hex_value, resolve
from gleanery.operators import dedup, graph, profile, verify
from gleanery.operators.hamming import members, near_links, near_pairs
from gleanery.plans.registry import query
from gleanery.plans.tables import _HEX, SPLITS, SQL_ALIASES, SQL_HELD, SQL_POOL, SQL_WORDS, classes, held_out, pool, sql_apart, sql_near, sql_words
from gleanery.runtime import table

W_POOL = "WITH RECURSIVE " + SQL_POOL


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_NEAR = W_POOL + SQL_WORDS + f", near AS (SELECT a.image_id AS a_id, b.image_id AS b_id, {sql_apart('a.h', 'b.h')} AS distance, a.class_name AS a_class, b.class_name AS b_class, a.source AS a_source, b.source AS b_source, a.split AS a_split, b.split AS b_split FROM w a JOIN w b ON a.image_id < b.image_id WHERE {sql_near('a', 'b')})"
_EDGES = ", e AS (SELECT a_id AS x, b_id AS y FROM near UNION SELECT b_id, a_id FROM near), reach AS (SELECT x AS node, x AS other FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON e.x = r.other), comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node), grouped AS (SELECT p.*, coalesce(c.component, p.image_id) AS component FROM pool p LEFT JOIN comp c ON c.node = p.image_id)"


@query(f"WITH {SQL_ALIASES} SELECT class_name AS raw, canonical, count(*) AS n FROM pool_images LEFT JOIN calias ON k = nullif(translate(lower(trim(class_name)), ' -', '__'), '') GROUP BY ALL")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    x = resolve(table(spark, d, "pool_images"), "class_name", alias_table(table(spark, d, "classes"), "class_name", order="idx"), "canonical")
    return x.groupBy(F.col("class_name").alias("raw"), "canonical").agg(F.count("*").alias("n"))


@query("""SELECT lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) AS ext,
    (split_part(source_path, '/', -1) IN (@names) OR split_part(source_path, '/', -1) LIKE '.\\_%' ESCAPE '\\'
     OR list_has_any(string_split(source_path, '/'), [@folders])) AS metadata, count(*) AS n
    FROM removed_images GROUP BY ALL""".replace("@names", _quoted(S.METADATA_NAMES)).replace("@folders", _quoted(S.METADATA_FOLDERS)))
def path_inventory(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "removed_images").withColumn("ext", S.extension(F.col("source_path"))).withColumn("metadata", S.is_metadata(F.col("source_path")))
    return x.groupBy("ext", "metadata").agg(F.count("*").alias("n"))


_SAFE = "regexp_replace(regexp_replace(replace({0}, '/', '_'), '[^A-Za-z0-9._\\-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    W_POOL
    + f""" SELECT image_id, source || '__' || {_SAFE.format("regexp_extract(source_path, '^(.*)/[^/]*$', 1)")} || '__' || {_SAFE.format("regexp_extract(source_path, '([^/]*)[.][^./]*$', 1)")} || '.'
    || CASE WHEN converted IS NOT NULL THEN regexp_extract(converted, '->(\\w+)$', 1) ELSE lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) END AS staged FROM pool"""
)
def staged_names(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d, "source", "source_path", "converted").select("image_id", S.staged_name(F.col("source"), F.col("source_path"), F.col("converted")).alias("staged"))


@query("""SELECT batch_no, CASE WHEN width IS NULL OR height IS NULL THEN 'unreadable' WHEN width * height = 0 THEN 'empty'
    WHEN lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) NOT IN (@extensions) THEN 'unsupported extension'
    WHEN least(width, height) < 32 THEN 'too small' ELSE 'ok' END AS reason, count(*) AS n FROM intake_images GROUP BY ALL""".replace("@extensions", _quoted(S.EXTENSIONS)))
def inspect_reasons(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.sources.images import rejection

    x = table(spark, d, "intake_images")
    reason = rejection(F.col("width").isNotNull() & F.col("height").isNotNull(), F.col("width") * F.col("height"), S.extension(F.col("source_path")), F.lit(True), F.col("width"), F.col("height"))
    return x.groupBy("batch_no", F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT status, message, count(*) AS n FROM (SELECT CASE WHEN file IS NULL OR trim(file) = '' THEN 400 WHEN lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) NOT IN (@extensions) THEN 415
    WHEN sha256 IS NULL OR trim(sha256) = '' THEN 400 WHEN phash IS NULL OR trim(phash) = '' THEN 400 ELSE 200 END AS status,
    CASE WHEN file IS NULL OR trim(file) = '' THEN 'no file name' WHEN lower(regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1)) NOT IN (@extensions) THEN 'unsupported extension'
    WHEN sha256 IS NULL OR trim(sha256) = '' THEN 'empty file' WHEN phash IS NULL OR trim(phash) = '' THEN 'not an image' ELSE 'ok' END AS message FROM v3_external_fingerprints) GROUP BY ALL""".replace("@extensions", _quoted(S.EXTENSIONS)))
def upload_rules(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.sources.images import upload_status

    filled = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    x = table(spark, d, "v3_external_fingerprints")
    size = F.when(filled("sha256"), 1024).otherwise(0)
    side = F.when(filled("phash"), 64)
    x = x.select(upload_status(F.lit(True), F.col("file"), size, side, side).alias("s")).select("s.*")
    return x.groupBy("status", "message").agg(F.count("*").alias("n"))


@query(W_POOL + " SELECT class_name, family, ('0x' || substr(sha256(concat_ws('|', '42', class_name, family)), 1, 16))::UBIGINT::VARCHAR AS seed FROM (SELECT DISTINCT class_name, family FROM pool)")
def stable_seeds(spark: SparkSession, d: str) -> DataFrame:
    x = pool(spark, d, "class_name", "family").select("class_name", "family").distinct()
    return x.withColumn("seed", S.stable_seed(F.lit("42"), F.col("class_name"), F.col("family")).cast("string"))


@query(W_POOL + SQL_WORDS + f" SELECT pair_id, n.distance, ({sql_apart('a.h', 'b.h')}) AS recomputed FROM near_pairs n JOIN w a ON a.image_id = n.image_a JOIN w b ON b.image_id = n.image_b AND length(a.phash) = length(b.phash)")
def recomputed_distances(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "phash").filter("phash is not null").select("image_id", "phash")
    x = table(spark, d, "near_pairs").select("pair_id", "image_a", "image_b", "distance")
    x = x.join(p.withColumnsRenamed({"image_id": "image_a", "phash": "ha"}), "image_a").join(p.withColumnsRenamed({"image_id": "image_b", "phash": "hb"}), "image_b")
    return x.filter("length(ha) = length(hb)").select("pair_id", "distance", S.hamming(F.col("ha"), F.col("hb")).alias("recomputed"))


@query(W_POOL + " SELECT class_name, count(*) AS n, round(avg(width * height / 1e6), 10) AS megapixels, round(avg(CASE WHEN height = 0 THEN 0.0 ELSE width / height END), 10) AS aspect, format('{:.1f}%', 100.0 * count(width) / count(*)) AS with_size FROM pool GROUP BY class_name")
def size_stats(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return pool(spark, d, "class_name", "width", "height").groupBy("class_name").agg(
        F.count("*").alias("n"), F.round(F.avg(S.megapixels(w, h)), 10).alias("megapixels"), F.round(F.avg(S.aspect(w, h)), 10).alias("aspect"), S.percent(F.count("width") / F.count("*")).alias("with_size")
    )


@query(
    W_POOL
    + """, f AS (SELECT class_name, e, count(*) AS c FROM (SELECT class_name, lower(regexp_extract(source_path, '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pool WHERE width IS NOT NULL AND height IS NOT NULL) GROUP BY ALL),
    g AS (SELECT class_name, string_agg(e || '=' || c, ', ' ORDER BY e) AS formats FROM f GROUP BY class_name),
    b AS (SELECT class_name, count(*) AS total, count(*) FILTER (width IS NOT NULL AND height IS NOT NULL) AS valid, avg(width) FILTER (width IS NOT NULL AND height IS NOT NULL) AS mw, avg(height) FILTER (width IS NOT NULL AND height IS NOT NULL) AS mh FROM pool GROUP BY class_name)
    SELECT c.class_name, coalesce(total, 0) AS total, coalesce(valid, 0) AS valid, coalesce(total, 0) - coalesce(valid, 0) AS invalid, round(coalesce(valid, 0) / sum(coalesce(valid, 0)) OVER (), 10) AS share, round(mw, 10) AS mean_width, round(mh, 10) AS mean_height, formats
    FROM classes c LEFT JOIN b USING (class_name) LEFT JOIN g USING (class_name)"""
)
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "class_name", "width", "height", "source_path").withColumn("valid", F.col("width").isNotNull() & F.col("height").isNotNull()).withColumn("ext", S.extension(F.col("source_path")))
    x = profile.corpus_profile(p, classes(spark, d), "valid", "ext")
    return x.withColumns({c: F.round(c, 10) for c in ("share", "mean_width", "mean_height")})


def _class_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = pool(spark, d, "class_name").groupBy("class_name").agg(F.count("*").alias("n"))
    return classes(spark, d).join(counts, "class_name", "left").na.fill(0, ["n"])


_COUNTS = W_POOL + ", counts AS (SELECT c.class_name, idx, count(p.image_id) AS n FROM classes c LEFT JOIN pool p USING (class_name) GROUP BY ALL)"


@query(_COUNTS + " SELECT count(*) AS classes, round(max(n) / min(n), 10) AS ratio, max(n) / min(n) > 3.0 AS warn FROM counts WHERE n > 0")
def imbalance(spark: SparkSession, d: str) -> DataFrame:
    return profile.imbalance(_class_counts(spark, d), 3.0).withColumn("ratio", F.round("ratio", 10))


@query(_COUNTS + " SELECT class_name, n FROM counts WHERE n > 0 AND n < 200")
def too_few(spark: SparkSession, d: str) -> DataFrame:
    return profile.too_few(_class_counts(spark, d), 200)


@query(W_POOL + ", s AS (SELECT sha256, count(*) AS n FROM pool WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1) SELECT sha256, source || '/' || source_path AS member, n FROM pool JOIN s USING (sha256)")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_groups(pool(spark, d, "source", "source_path", "sha256").withColumn("uid", dedup.uid()), "sha256", "uid")


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The pool with its order of scanning: class, source, path, id."""
    x = pool(spark, d, "class_name", "source", "family", "source_path", "sha256").join(classes(spark, d), "class_name", "left").withColumn("uid", dedup.uid())
    return x.withColumn("idx", F.coalesce("idx", F.lit(999)))


@query(W_POOL + ", r AS (SELECT p.*, row_number() OVER (PARTITION BY sha256 ORDER BY coalesce(idx, 999), p.source || '/' || source_path, image_id) AS k FROM pool p LEFT JOIN classes c USING (class_name)) SELECT class_name, count(*) FILTER (sha256 IS NULL OR k = 1) AS kept, count(*) FILTER (sha256 IS NOT NULL AND k > 1) AS dropped FROM r GROUP BY class_name")
def exact_dedup_global(spark: SparkSession, d: str) -> DataFrame:
    kept, removed = dedup.keep_first(_ordered(spark, d), ["sha256"], ["idx", "uid", "image_id"], "uid")
    both = kept.select("class_name", F.lit(1).alias("k")).union(removed.select("class_name", F.lit(0)))
    return both.groupBy("class_name").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("dropped"))


@query(W_POOL + ", r AS (SELECT *, row_number() OVER (PARTITION BY class_name, sha256 ORDER BY source || '/' || source_path, image_id) AS k FROM pool) SELECT class_name, count(*) FILTER (sha256 IS NULL OR class_name IS NULL OR k = 1) AS kept, count(*) FILTER (sha256 IS NOT NULL AND class_name IS NOT NULL AND k > 1) AS dropped FROM r GROUP BY class_name")
def exact_dedup_per_class(spark: SparkSession, d: str) -> DataFrame:
    kept, removed = dedup.keep_first(pool(spark, d, "class_name", "source", "family", "source_path", "sha256").withColumn("uid", dedup.uid()), ["class_name", "sha256"], ["uid", "image_id"], "uid")
    both = kept.select("class_name", F.lit(1).alias("k")).union(removed.select("class_name", F.lit(0)))
    return both.groupBy("class_name").agg(F.sum("k").alias("kept"), F.sum(1 - F.col("k")).alias("dropped"))


_LEDGER = (
    W_POOL
    + """, r AS (SELECT *, source || '/' || source_path AS uid, row_number() OVER (PARTITION BY class_name, sha256 ORDER BY source || '/' || source_path, image_id) AS k, first_value(source || '/' || source_path) OVER (PARTITION BY class_name, sha256 ORDER BY source || '/' || source_path, image_id) AS f FROM pool),
    kept AS (SELECT * FROM r WHERE sha256 IS NULL OR class_name IS NULL OR k = 1), bad AS (SELECT sha256 FROM kept WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT class_name) > 1),
    ledger AS (SELECT class_name, source, family, source_path, sha256, 'exact_duplicate' AS reason, f AS kept_instead FROM r WHERE sha256 IS NOT NULL AND class_name IS NOT NULL AND k > 1
    UNION ALL SELECT class_name, source, family, source_path, sha256, 'label_conflict_exact', NULL FROM kept SEMI JOIN bad USING (sha256))"""
)


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    kept, copies = dedup.keep_first(pool(spark, d, "class_name", "source", "family", "source_path", "sha256").withColumn("uid", dedup.uid()), ["class_name", "sha256"], ["uid", "image_id"], "uid")
    _, conflicts = dedup.label_conflicts(kept, "sha256", "class_name")
    return copies.unionByName(conflicts)


@query(_LEDGER + " SELECT * FROM ledger")
def removal_ledger(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).drop("detail")


@query(_LEDGER + " SELECT reason, class_name, source, count(*) AS n FROM ledger GROUP BY ALL")
def ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.removal_counts(_ledger(spark, d))


@query("SELECT reason, class_name, source, count(*) AS n FROM removed_images GROUP BY ALL")
def removal_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.removal_counts(table(spark, d, "removed_images"))


@query(W_POOL + ", bad AS (SELECT sha256 FROM pool WHERE sha256 IS NOT NULL GROUP BY sha256 HAVING count(DISTINCT class_name) > 1) SELECT image_id, class_name FROM pool SEMI JOIN bad USING (sha256)")
def label_conflict(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "class_name", "sha256")
    bad = p.filter("sha256 is not null").groupBy("sha256").agg(F.min("class_name").alias("lo"), F.max("class_name").alias("hi")).filter("lo < hi")
    return p.join(bad, "sha256", "left_semi").select("image_id", "class_name")


def _reps(by: str = "") -> str:
    """Pairs of near classes of equal hash (and `by`), by their least images."""
    extra = f", {by}" if by else ""
    words = ", ".join(f"{w} AS h{k}" for k, w in enumerate(sql_words("phash")))
    r = "WITH " + SQL_POOL + f", r AS (SELECT min(image_id) AS image_id, phash{extra} FROM pool WHERE phash IS NOT NULL GROUP BY phash{extra}), w AS (SELECT *, {words} FROM r)"
    both = f", a.{by} AS a_by, b.{by} AS b_by" if by else ""
    return r + f", pairs AS (SELECT a.image_id AS a_id, b.image_id AS b_id, {sql_apart('a.h', 'b.h')} AS distance{both} FROM w a JOIN w b ON a.image_id < b.image_id WHERE {sql_near('a', 'b')})"


@query(_reps() + " SELECT a_id, b_id, distance FROM pairs")
def near_pairs_pool(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs(pool(spark, d, "phash"), None, "image_id", "phash").select("a_id", "b_id", "distance")


@query("WITH " + SQL_POOL + " SELECT image_id, min(image_id) OVER (PARTITION BY phash) AS representative FROM pool WHERE phash IS NOT NULL")
def hash_members(spark: SparkSession, d: str) -> DataFrame:
    return members(pool(spark, d, "phash"), "image_id", "phash")


@query(_reps("class_name") + " SELECT a_id, b_id, distance, a_by AS class_name FROM pairs WHERE a_by = b_by")
def near_pairs_within_class(spark: SparkSession, d: str) -> DataFrame:
    x = near_pairs(pool(spark, d, "phash", "class_name"), None, "image_id", "phash", same=("class_name",))
    return x.select("a_id", "b_id", "distance", F.col("a_class_name").alias("class_name"))


def _grouped(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "phash", "class_name", "source")
    comp = graph.connected_components(near_links(p, "image_id", "phash"), "a_id", "b_id")
    x = p.join(comp.withColumnRenamed("node", "image_id"), "image_id", "left")
    return x.withColumn("component", F.coalesce("component", "image_id"))


@query(_NEAR + _EDGES + " SELECT node AS image_id, component FROM comp")
def near_components(spark: SparkSession, d: str) -> DataFrame:
    comp = graph.connected_components(near_links(pool(spark, d, "phash"), "image_id", "phash"), "a_id", "b_id")
    return comp.withColumnRenamed("node", "image_id")


@query(_NEAR + _EDGES + " SELECT image_id, dense_rank() OVER (ORDER BY component) - 1 AS number FROM grouped")
def group_numbers(spark: SparkSession, d: str) -> DataFrame:
    return graph.number_groups(_grouped(spark, d).select("image_id", "component"), "component", "number").select("image_id", "number")


@query(_NEAR + _EDGES + ", s AS (SELECT component, count(*) AS n, count(DISTINCT class_name) AS c FROM grouped GROUP BY component) SELECT count(*) FILTER (n > 1) AS groups, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS members, count(*) FILTER (n > 1 AND c > 1) AS cross_label FROM s")
def cross_class_groups(spark: SparkSession, d: str) -> DataFrame:
    return graph.group_counts(_grouped(spark, d), "component", "class_name")


_OVERLAP = _NEAR + _EDGES + """, s AS (SELECT class_name, component, count(*) AS n, count(DISTINCT source) > 1 AS cross_source FROM grouped GROUP BY ALL),
    ov AS (SELECT class_name, sum(n)::BIGINT AS images, count(*) FILTER (n > 1 AND NOT cross_source) AS within_groups, count(*) FILTER (cross_source) AS cross_groups, coalesce(sum(n) FILTER (cross_source), 0)::BIGINT AS cross_images, coalesce(max(n) FILTER (cross_source), 0)::BIGINT AS largest_cross FROM s GROUP BY class_name),
    sp AS (SELECT a.source AS "left", b.source AS "right", count(*) AS shared_groups FROM (SELECT DISTINCT component, source FROM grouped) a JOIN (SELECT DISTINCT component, source FROM grouped) b ON a.component = b.component AND a.source < b.source GROUP BY ALL)"""


@query(_OVERLAP + " SELECT *, round(cross_images / images, 10) AS cross_rate FROM ov")
def overlap_within_cross(spark: SparkSession, d: str) -> DataFrame:
    return profile.overlap(_grouped(spark, d), "component").withColumn("cross_rate", F.round("cross_rate", 10))


@query(_OVERLAP + " SELECT * FROM sp")
def source_pair_shared(spark: SparkSession, d: str) -> DataFrame:
    return profile.shared_sources(_grouped(spark, d), "component")


@query(_OVERLAP + """, n AS (SELECT source, count(*) AS n FROM pool GROUP BY source) SELECT 'class' AS kind, class_name AS name, round(cross_images / images, 10) AS value FROM ov WHERE cross_images / images > 0.05
    UNION ALL SELECT 'pair', "left" || '|' || "right", round(shared_groups / least(a.n, b.n), 10) FROM sp JOIN n a ON a.source = "left" JOIN n b ON b.source = "right" WHERE shared_groups / least(a.n, b.n) > 0.2""")
def overlap_verdict(spark: SparkSession, d: str) -> DataFrame:
    g = _grouped(spark, d)
    sizes = g.groupBy("source").agg(F.count("*").alias("n"))
    return profile.overlap_verdict(profile.overlap(g, "component"), profile.shared_sources(g, "component"), sizes).withColumn("value", F.round("value", 10))


@query(_NEAR + " , m AS (SELECT m.image_id, m.class_name, m.family, p.source AS ps, p.source_path AS pp, p.image_id AS pid, row_number() OVER (PARTITION BY m.image_id ORDER BY p.source, p.source_path, p.image_id) AS k FROM w m JOIN w p ON p.source = p.family AND m.source <> m.family AND p.family = m.family AND p.class_name = m.class_name WHERE " + sql_near("m", "p") + ") SELECT image_id, 'near_duplicate_of_' || family AS reason, family || '/' || pp AS kept_instead FROM m WHERE k = 1")
def family_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "class_name", "source", "family", "source_path", "sha256", "phash").withColumn("rank", F.col("source"))
    _, removed = dedup.drop_family_copies(p, "image_id", "phash", "rank")
    return removed.select("image_id", "reason", "kept_instead")


_HELD = W_POOL + SQL_WORDS + ", " + SQL_HELD + ", hw AS (SELECT *, " + ", ".join(f"{x} AS h{k}" for k, x in enumerate(sql_words("phash"))) + """ FROM held WHERE phash IS NOT NULL),
    hits AS (SELECT image_id, h.file, -1 AS apart FROM pool p JOIN held h ON h.sha256 = p.sha256 OR h.sha256 = p.original_sha256 UNION SELECT image_id, h.file, """ + sql_apart("w.h", "h.h") + " FROM w JOIN hw h ON " + sql_near("w", "h") + "), best AS (SELECT image_id, file, min(apart) AS apart FROM hits GROUP BY ALL)"


_HELD_INTAKE = (
    "WITH iw AS (SELECT intake_id, " + _HEX.format("sha256") + " AS sha256, " + _HEX.format("phash") + " AS phash FROM intake_images), "
    + SQL_HELD
    + ", w AS (SELECT *, " + ", ".join(f"{x} AS h{k}" for k, x in enumerate(sql_words("phash"))) + " FROM iw WHERE phash IS NOT NULL), hw AS (SELECT *, "
    + ", ".join(f"{x} AS h{k}" for k, x in enumerate(sql_words("phash"))) + """ FROM held WHERE phash IS NOT NULL),
    hits AS (SELECT intake_id, h.file, -1 AS apart FROM iw JOIN held h ON h.sha256 = iw.sha256 UNION SELECT intake_id, h.file, """ + sql_apart("w.h", "h.h") + " FROM w JOIN hw h ON " + sql_near("w", "h") + "), best AS (SELECT intake_id, file, min(apart) AS apart FROM hits GROUP BY ALL)"
)


@query(_HELD_INTAKE + " SELECT intake_id, string_agg(CASE WHEN apart < 0 THEN 'exact ' || file ELSE 'near ' || file || ' (' || apart || ' bits)' END, '; ' ORDER BY apart >= 0, file) AS detail FROM best GROUP BY intake_id")
def heldout_overlap(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "intake_images").withColumns({c: hex_value(F.col(c)) for c in ("sha256", "phash")})
    x = x.withColumn("source", F.col("intake_id").cast("string"))
    _, removed = dedup.drop_held_out(x, held_out(spark, d), "intake_id", ["sha256"], "phash")
    return removed.select(F.col("source").cast("bigint").alias("intake_id"), "detail")


@query(_reps("split") + " SELECT a_id, b_id, distance FROM pairs WHERE a_by <> b_by")
def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return verify.near_leaks(pool(spark, d, "phash", "split"), "image_id", "phash").select("a_id", "b_id", "distance")


@query(W_POOL + " SELECT c.class_name, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test, count(p.image_id) AS total FROM classes c LEFT JOIN pool p USING (class_name) GROUP BY c.class_name")
def split_counts(spark: SparkSession, d: str) -> DataFrame:
    return profile.split_counts(pool(spark, d, "class_name", "split"), classes(spark, d), SPLITS)


@query(W_POOL + """, v AS (SELECT 'full' AS variant, * FROM pool WHERE split IS NOT NULL UNION ALL SELECT 'balanced', * FROM pool WHERE split IS NOT NULL AND in_balanced)
    SELECT variant, grouping(class_name, split, family, source) AS level, class_name, split, family, source, count(*) AS n FROM v
    GROUP BY variant, GROUPING SETS ((class_name, split), (class_name, family), (class_name, source), (class_name, split, family), (class_name), (split))""")
def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.variant_summary(pool(spark, d, "class_name", "split", "family", "source", "in_balanced"))


@query(W_POOL + """, r AS (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY source || '/' || source_path, image_id) AS k FROM pool)
    SELECT CASE WHEN sha256 IS NULL THEN 'unreadable' ELSE 'exact_duplicate' END AS reason, source, count(*) AS n FROM r WHERE sha256 IS NULL OR k > 1 GROUP BY ALL""")
def exact_dedup_unread(spark: SparkSession, d: str) -> DataFrame:
    """Copies leave, and so does what has no content hash."""
    p = pool(spark, d, "class_name", "source", "family", "source_path", "sha256").withColumn("uid", dedup.uid())
    _, removed = dedup.keep_first(p, ["sha256"], ["uid", "image_id"], "uid", unread="unreadable")
    return removed.groupBy("reason", "source").agg(F.count("*").alias("n"))


@query(W_POOL + " SELECT class_name, source, count(*) AS expected FROM pool WHERE class_name IS NOT NULL GROUP BY ALL")
def expected_counts(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d, "class_name", "source").filter("class_name is not null").groupBy("class_name", "source").agg(F.count("*").alias("expected"))


@query(W_POOL + ", s AS (SELECT class_name, source, count(*) AS n FROM pool WHERE class_name IS NOT NULL GROUP BY ALL) SELECT class_name, count(*) AS sources, sum(n)::BIGINT AS total, round(max(n) / sum(n), 10) AS largest_share FROM s GROUP BY class_name")
def largest_source_share(spark: SparkSession, d: str) -> DataFrame:
    return profile.largest_source(expected_counts(spark, d).withColumnRenamed("expected", "available")).withColumn("largest_share", F.round("largest_share", 10))


@query(W_POOL + ", e AS (SELECT source, count(*) AS expected FROM pool GROUP BY source), f AS (SELECT source, count(*) AS found FROM pool WHERE in_balanced GROUP BY source) SELECT source, coalesce(expected, 0) AS expected, coalesce(found, 0) AS found FROM e FULL JOIN f USING (source) WHERE abs(coalesce(found, 0) - coalesce(expected, 0)) > greatest(5.0, coalesce(expected, 0) * 0.1)")
def count_drift(spark: SparkSession, d: str) -> DataFrame:
    p = pool(spark, d, "source", "in_balanced")
    return profile.count_drift(p.groupBy("source").agg(F.count("*").alias("expected")), p.filter("in_balanced").groupBy("source").agg(F.count("*").alias("found")), ["source"])


@query(W_POOL + ", a AS (SELECT DISTINCT source || '/' || source_path AS uid FROM pool), b AS (SELECT DISTINCT kept_instead AS uid FROM removed_images WHERE kept_instead IS NOT NULL) SELECT uid, 'left' AS only_in, 1::BIGINT AS n FROM a ANTI JOIN b USING (uid) UNION ALL SELECT uid, 'right', 1 FROM b ANTI JOIN a USING (uid)")
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    a = pool(spark, d, "source", "source_path").select(dedup.uid().alias("uid")).distinct()
    b = table(spark, d, "removed_images").select(F.col("kept_instead").alias("uid")).filter("uid is not null").distinct()
    return verify.difference(a, b, ["uid"])


_STRADDLE = "(SELECT count(*) FROM (SELECT {0} FROM pool WHERE {0} IS NOT NULL AND split IS NOT NULL GROUP BY {0} HAVING count(DISTINCT split) > 1))"
_CHECKS = (
    _HELD
    + f", q AS (SELECT phash, split, min(image_id) AS image_id, any_value(h0) AS h0, any_value(h1) AS h1, any_value(h2) AS h2, any_value(h3) AS h3 FROM w WHERE split IS NOT NULL GROUP BY phash, split), near AS (SELECT a.image_id FROM q a JOIN q b ON a.image_id < b.image_id AND a.split <> b.split WHERE {sql_near('a', 'b')})"
    + ", v AS (SELECT 'exact_straddles_splits' AS name, " + _STRADDLE.format("sha256") + " AS violations UNION ALL SELECT 'group_straddles_splits', " + _STRADDLE.format("group_id")
    + """ UNION ALL SELECT 'near_straddles_splits', (SELECT count(*) FROM near)
    UNION ALL SELECT 'held_out_exact', (SELECT count(DISTINCT image_id) FROM hits WHERE apart < 0)
    UNION ALL SELECT 'held_out_near', (SELECT count(*) FROM (SELECT DISTINCT phash, h2.file FROM hits h2 JOIN pool USING (image_id) WHERE apart >= 0))
    UNION ALL SELECT 'balanced_without_split', (SELECT count(*) FROM pool WHERE in_balanced AND split IS NULL)
    UNION ALL SELECT 'webp_left', (SELECT count(*) FROM pool WHERE lower(source_path) LIKE '%.webp' AND converted IS NULL)
    UNION ALL SELECT 'name_collisions', (SELECT count(*) FROM (SELECT staged_name FROM pool GROUP BY staged_name HAVING count(DISTINCT image_id) > 1)))"""
)


@query(_CHECKS + " SELECT name, violations, violations = 0 AS passed FROM v")
def verify_checks(spark: SparkSession, d: str) -> DataFrame:
    return verify.checks(pool(spark, d, "sha256", "original_sha256", "phash", "group_id", "split", "in_balanced", "source_path", "converted", "staged_name"), held_out(spark, d))


@query(_CHECKS + " SELECT count(*) FILTER (violations = 0) AS passed_checks, count(*) AS checks, bool_and(violations = 0) AS passed FROM v")
def verify_summary(spark: SparkSession, d: str) -> DataFrame:
    return verify.verdict(verify_checks(spark, d))
