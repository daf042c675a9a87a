"""The queries of this package over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions.names import alias_table, normalised, resolve
from gleanery.llm.components import match_groups
from gleanery.llm.encoding import count_tokens, encode
from gleanery.llm.intake import FingerprintIndex, check_batches, fingerprints
from gleanery.llm.mixing import SourceMix
from gleanery.llm.mojibake import Repair
from gleanery.llm.sampling import TargetSample, distinct_records
from gleanery.llm.splits import grouped_split, reached_shares, split_conflicts, split_shares
from gleanery.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pool = fingerprints(table(spark, d, "pool_images"), [], ["sha256", "original_sha256"], "phash")
    held_out = fingerprints(table(spark, d, "v3_external_fingerprints"), [], ["sha256"], "phash")
    index = FingerprintIndex(spark).create(pool.union(held_out))
    found = check_batches(index, table(spark, d, "intake_images"), "batch_no", "intake_id", ["sha256"], "phash")
    index.drop()
    return found


def _sample(spark: SparkSession, d: str) -> TargetSample:
    classes = alias_table(table(spark, d, "classes"), "class_name")
    splits = alias_table(table(spark, d, "split_targets"), "split_name")
    source = F.when(F.trim("source") != "", F.trim("source"))
    family = F.coalesce(F.when(F.trim("family") != "", F.trim("family")), F.lit(""))
    images = distinct_records(
        table(spark, d, "pool_images"),
        "image_id",
        [normalised(F.col("class_name")), normalised(F.col("split")), source, family, F.col("in_balanced")],
        ["class_key", "split_key", "source", "family", "flag"],
    )
    images = resolve(resolve(images, "class_key", classes, "class_name"), "split_key", splits, "split")
    # Diseases whose names end alike, as the rusts do, are siblings.
    records = images.withColumn("scope", F.col("split")).withColumn("kind", F.element_at(F.split("class_name", " "), -1))
    plans = table(spark, d, "sample_targets")
    return TargetSample(records, plans, {"source": "family", "class_name": "kind"}, {"class_name": "source", "source": "class_name", "split": "class_name"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).unmet()


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).report()


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sample(spark, d).draw()


def _splits(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "split_targets")
    names = split_shares(targets, "split_name", "target_share")
    classes = alias_table(table(spark, d, "classes"), "class_name")
    images = table(spark, d, "pool_images").select("image_id", "class_name", "family", "split", F.when(F.col("group_id") >= 0, F.col("group_id")).alias("group_id"))
    images = resolve(images, "split", alias_table(targets, "split_name"), "recorded")
    images = resolve(images, "class_name", classes, "class")
    return grouped_split(images, "image_id", ["group_id", "image_id"], ["class", "family"], names)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups that the assignment has to bring together: rows off their component's split and off each other."""
    return split_conflicts(_splits(spark, d), "group_id", "recorded")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return _splits(spark, d).select("image_id", "group_id", "component", "assigned").distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    return reached_shares(_splits(spark, d), ["class", "family"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    groups = match_groups(table(spark, d, "near_pairs"), table(spark, d, "pool_images"), "image_a", "image_b", "image_id")
    return groups.select(F.col("group").alias("group_image_id"), F.col("record").alias("image_id"))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def _mix(spark: SparkSession, d: str) -> SourceMix:
    documents = table(spark, d, "documents").withColumn("text_key", F.unhex(F.sha2("text", 256)))
    sized = count_tokens(documents.select(F.col("doc_id").alias("doc"), "source", "text_key", "text"), ["doc", "source", "text_key"])
    return SourceMix(spark, sized, table(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).unmet()


def p6_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).draw()


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "documents")).found()


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "documents")).restored()


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_report, p2_sample, p3_found, p3_splits, p3_shares, p4_found, p5_ids, p6_found, p6_mix, p6_shares, p7_found, p7_restored)}


_CANON = """WITH RECURSIVE alias AS (SELECT 'class_name' AS f, class_name AS c, unnest(list_append(aliases, class_name)) AS a FROM classes UNION ALL SELECT 'split', split_name, unnest(list_append(aliases, split_name)) FROM split_targets),
    k AS (SELECT f, nullif(translate(lower(trim(a)), ' -', '__'), '') AS k, min(c) AS c FROM alias GROUP BY ALL)"""

_HEX = "nullif(regexp_replace(regexp_replace(lower({0}), '[\\s:-]+', '', 'g'), '^0x', ''), '')"
_APART = " + ".join(f"bit_count(xor(('0x' || rpad(substr(a.p, {16 * k + 1}, 16), 16, '0'))::UBIGINT, ('0x' || rpad(substr(b.p, {16 * k + 1}, 16), 16, '0'))::UBIGINT))::INT" for k in range(4))

ORACLES: dict[str, str] = {
    "p1_found": "WITH RECURSIVE known AS MATERIALIZED (SELECT DISTINCT "
    + f"{_HEX.format('sha256')} AS s, {_HEX.format('original_sha256')} AS o, {_HEX.format('phash')} AS p FROM pool_images UNION SELECT {_HEX.format('sha256')}, NULL, {_HEX.format('phash')} FROM v3_external_fingerprints),"
    + f" new AS MATERIALIZED (SELECT intake_id, row_number() OVER (ORDER BY batch_no, intake_id) AS i, {_HEX.format('sha256')} AS s, {_HEX.format('phash')} AS p FROM intake_images),"
    + " hit AS MATERIALIZED (SELECT i FROM new WHERE s IN (SELECT s FROM known WHERE s IS NOT NULL UNION SELECT o FROM known WHERE o IS NOT NULL) UNION SELECT a.i FROM new a JOIN (SELECT DISTINCT p FROM known WHERE p IS NOT NULL) b"
    + f" ON length(a.p) = length(b.p) AND {_APART} <= 5), fresh AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY i) AS k FROM new WHERE i NOT IN (FROM hit)),"
    + f" near AS MATERIALIZED (SELECT b.k, list(a.k) AS before FROM fresh a JOIN fresh b ON a.k < b.k AND (a.s = b.s OR length(a.p) = length(b.p) AND {_APART} <= 5) GROUP BY b.k),"
    + " todo AS MATERIALIZED (SELECT k, coalesce(before, []) AS before FROM fresh LEFT JOIN near USING (k)),"
    + " turn AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS accepted UNION ALL SELECT t.k, CASE WHEN list_has_any(accepted, t.before) THEN accepted ELSE list_append(accepted, t.k) END FROM turn JOIN todo t ON t.k = turn.k + 1),"
    + " done AS (SELECT unnest(accepted) AS k FROM turn WHERE k = (SELECT max(k) FROM turn))"
    + " SELECT intake_id FROM new WHERE i IN (FROM hit) UNION ALL SELECT intake_id FROM fresh WHERE k NOT IN (FROM done)",
    "p2_found": _CANON
    + """, img AS (SELECT DISTINCT image_id, x.c AS class_name, y.c AS split, nullif(trim(source), '') AS source, in_balanced FROM pool_images p
        LEFT JOIN k x ON x.f = 'class_name' AND x.k = translate(lower(trim(p.class_name)), ' -', '__') LEFT JOIN k y ON y.f = 'split' AND y.k = translate(lower(trim(p.split)), ' -', '__')),
    head AS (SELECT DISTINCT plan_id, category_field, scope_split, scope_balanced, sample_share FROM sample_targets),
    scoped AS (SELECT plan_id, sample_share, CASE category_field WHEN 'class_name' THEN class_name WHEN 'split' THEN split ELSE source END AS category, image_id FROM img, head
        WHERE (scope_split IS NULL OR split = scope_split) AND (scope_balanced IS NULL OR in_balanced = scope_balanced)),
    size AS (SELECT plan_id, floor(any_value(sample_share) * count(DISTINCT image_id)) AS size FROM scoped GROUP BY plan_id),
    have AS (SELECT plan_id, category, count(DISTINCT image_id) AS n FROM scoped GROUP BY ALL)
    SELECT t.plan_id, t.category FROM sample_targets t LEFT JOIN size USING (plan_id) LEFT JOIN have h ON h.plan_id = t.plan_id AND h.category = t.category
    WHERE greatest(min_rows, floor(target_share * coalesce(size, 0))) > coalesce(h.n, 0)""",
    "p3_found": _CANON
    + """ SELECT group_id FROM pool_images JOIN k ON k.f = 'split' AND k.k = translate(lower(trim(split)), ' -', '__') WHERE group_id >= 0 GROUP BY group_id HAVING count(DISTINCT k.c) > 1""",
    "p4_found": """WITH RECURSIVE ids AS (SELECT DISTINCT image_id FROM pool_images),
    e AS (SELECT image_a AS a, image_b AS b FROM near_pairs WHERE image_a <> image_b AND distance <= 5 AND image_a IN (FROM ids) AND image_b IN (FROM ids)),
    both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other)
    SELECT min(other) AS group_image_id, node AS image_id FROM reach GROUP BY node""",
}
