"""Queries on completeness, profiles, labels, duplicates and leakage."""

from pyspark.sql import functions as F

from plumbline.operators import clusters, dedup, profile, quality
from plumbline.plans.registry import query
from plumbline.roles import Roles
from plumbline.sources import fixtures as fx
from plumbline.sources.fixtures import table
from plumbline.sources.tables import materialized

_FAULTED_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    "o_orderpriority", "split"]


def _union(template: str, columns) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


_MISSING = "WITH " + fx.FAULTED_SQL + ", m AS (" + _union(
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, count(*) AS rows FROM faulted",
    _FAULTED_COLUMNS) + ")"


@query(_MISSING + """ SELECT "column", missing, rows, round(missing / rows, 6) AS missing_rate FROM m
  ORDER BY missing_rate DESC, "column" LIMIT 10""")
def missing_by_column(spark, sf):
    return profile.top(profile.missing_by_column(fx.faulted_orders(spark, sf)), 10, "missing_rate", "column")


@query(_MISSING + " SELECT round(sum(missing) / sum(rows), 6) AS missing_rate, max(rows) AS rows FROM m")
def missing_overall(spark, sf):
    return profile.missing_overall(fx.faulted_orders(spark, sf))


@query("SELECT 0 AS position, 'p_partkey' AS \"column\", 'numeric' AS type, 'bigint' AS dtype WHERE (SELECT count(*) FROM part) > 0 "
       "UNION ALL SELECT 1, 'p_name', 'categorical', 'string' UNION ALL SELECT 2, 'p_brand', 'categorical', 'string' "
       "UNION ALL SELECT 3, 'p_type', 'categorical', 'string' UNION ALL SELECT 4, 'p_size', 'numeric', 'int' "
       "UNION ALL SELECT 5, 'p_retailprice', 'numeric', 'double'")
def column_types(spark, sf):
    return profile.column_types(table(spark, sf, "part"))


_PART = {"p_partkey": "numeric", "p_name": "categorical", "p_brand": "categorical", "p_type": "categorical",
         "p_size": "numeric", "p_retailprice": "numeric"}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS type, round((count(*) - count({c})) / count(*), 6) AS missing_rate, "
    f"count(DISTINCT {c}) AS distinct_values, {repr('id') if c == 'p_partkey' else 'CAST(NULL AS VARCHAR)'} AS role "
    "FROM part" for c, t in _PART.items()))
def column_profile(spark, sf):
    return profile.column_profile(table(spark, sf, "part"), Roles(ids=("p_partkey",))).drop("samples")


@query("WITH v AS (SELECT DISTINCT p_brand AS value FROM part), r AS (SELECT value, row_number() OVER (ORDER BY value) AS rn FROM v) "
       "SELECT 'p_brand' AS \"column\", string_agg(value, ',' ORDER BY value) AS samples FROM r WHERE rn <= 3")
def profile_samples(spark, sf):
    card = profile.column_profile(table(spark, sf, "part"))
    return card.filter(F.col("column") == "p_brand").select("column", F.array_join("samples", ",").alias("samples"))


@query("WITH t AS (SELECT *, 'x' AS c1, CAST(NULL AS INTEGER) AS c2, CASE WHEN p_partkey > 0 THEN 1 END AS c3 FROM part) "
       + _union("SELECT '{c}' AS \"column\", (count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) <= 1 AS constant FROM t",
                [*_PART, "c1", "c2", "c3"]))
def constant_columns(spark, sf):
    frame = table(spark, sf, "part").withColumns({
        "c1": F.lit("x"), "c2": F.lit(None).cast("int"), "c3": F.when(F.col("p_partkey") > 0, 1)})
    return profile.constant_columns(frame)


@query("SELECT count(*) AS num_rows, CAST(7 AS BIGINT) AS num_cols, CAST(1 AS BIGINT) AS num_constant, 'c1' AS constant_columns FROM part")
def schema_consistency(spark, sf):
    return profile.schema_consistency(table(spark, sf, "part").withColumn("c1", F.lit("x")))


@query("WITH " + fx.FAULTED_SQL + " SELECT o_orderpriority AS value, count(*) AS n FROM faulted GROUP BY 1 ORDER BY n DESC, value NULLS FIRST LIMIT 20")
def top_values(spark, sf):
    return profile.top_values(fx.faulted_orders(spark, sf), "o_orderpriority")


@query("SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, "
       "round(min(c_acctbal), 6) AS min, round(max(c_acctbal), 6) AS max FROM customer")
def numeric_describe(spark, sf):
    return profile.describe(table(spark, sf, "customer"), "c_acctbal")


@query("""WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi,
  least(30, CAST(floor(sqrt(count(c_acctbal))) AS INTEGER) + 5) AS k FROM customer),
h AS (SELECT least(CAST(floor((c_acctbal - lo) / (hi - lo) * k) AS BIGINT), k - 1) AS bin FROM customer, s)
SELECT bin, round(lo + (hi - lo) * bin / k, 6) AS low_edge, count(*) AS n FROM h, s GROUP BY bin, lo, hi, k""")
def histogram(spark, sf):
    return profile.histogram(table(spark, sf, "customer"), "c_acctbal")


@query("WITH " + fx.DOC_SQL + " SELECT round(avg(((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT + 6) / 8.0), 6) AS completeness FROM doc")
def row_completeness(spark, sf):
    return profile.row_completeness(fx.doc_labels(spark, sf))


@query("WITH " + fx.DOC_SQL + ", f AS (" + _union(
    "SELECT '{c}' AS \"column\", count({c}) / count(*) AS completeness FROM doc",
    ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic", "split"])
    + ') SELECT "column", round(completeness, 6) AS completeness FROM f ORDER BY completeness, "column" LIMIT 5')
def field_completeness(spark, sf):
    return profile.field_completeness(fx.doc_labels(spark, sf))


@query("WITH " + fx.DOC_SQL + ", s AS (SELECT CASE WHEN quality IS NOT NULL THEN split END AS split FROM doc) "
       "SELECT split, count(*) AS n, round((SELECT count(split) / count(*) FROM s), 6) AS split_coverage FROM s GROUP BY split")
def split_coverage(spark, sf):
    docs = fx.doc_labels(spark, sf).withColumn("split", F.when(F.col("quality").isNotNull(), F.col("split")))
    return profile.split_coverage(docs, "split")


@query("WITH " + fx.FAULTED_SQL + " SELECT round(avg(CASE WHEN o_totalprice IS NOT NULL OR o_orderpriority IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage_rate FROM faulted")
def source_coverage_any(spark, sf):
    return profile.coverage(fx.faulted_orders(spark, sf), ["o_totalprice", "o_orderpriority"], "any")


@query("WITH " + fx.FAULTED_SQL + " SELECT round(avg(CASE WHEN o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS coverage_rate FROM faulted")
def traceability_coverage_all(spark, sf):
    return profile.coverage(fx.faulted_orders(spark, sf), ["o_totalprice", "o_orderpriority"], "all")


@query("WITH " + fx.FAULTED_SQL + """ SELECT strftime(o_orderdate, '%Y-%m') AS slice,
  round(((count(*) - count(o_totalprice)) + (count(*) - count(o_orderpriority))) / (count(*) * 7.0), 6) AS missing_rate,
  count(*) AS rows FROM faulted GROUP BY 1""")
def missing_by_slice(spark, sf):
    frame = fx.faulted_orders(spark, sf)
    sliced = frame.withColumn("slice", F.date_format("o_orderdate", "yyyy-MM"))
    return profile.missing_by_slice(sliced, "slice", frame.columns)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def entity_counts(spark, sf):
    return profile.entity_counts(table(spark, sf, "events"), ["user_id"])


@query("WITH v AS (" + _union("SELECT '{c}' AS \"column\", var_samp({c}) AS variance FROM lineitem",
       ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]) +
       ') SELECT "column", round(variance, 4) AS variance FROM v ORDER BY variance DESC, "column" LIMIT 2', digits=4)
def top_variance_columns(spark, sf):
    return profile.numeric_variances(
        table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)


def _task_sql(c: str, numeric: bool, source: str, name: str) -> str:
    return (f"SELECT '{name}' AS label, count(DISTINCT {c}) AS distinct_labels, CASE WHEN {numeric} AND count(DISTINCT {c}) > 20 "
            f"AND count(DISTINCT {c}) > 0.05 * count(*) THEN 'Regression' WHEN count(DISTINCT {c}) = 2 THEN 'Binary classification' "
            f"WHEN count(DISTINCT {c}) > 2 AND count(DISTINCT {c}) <= 50 THEN 'Multi-class classification' "
            f"ELSE 'Label selected (card=' || count(DISTINCT {c}) || ')' END AS task_type FROM {source}")


@query(" UNION ALL ".join([
    _task_sql("o_totalprice", True, "orders", "price"), _task_sql("o_orderstatus", False, "orders", "status"),
    _task_sql("quality", True, "labels", "quality"), _task_sql("c_name", False, "customer", "name")]))
def task_type(spark, sf):
    parts = [("orders", "o_totalprice", "price"), ("orders", "o_orderstatus", "status"),
             ("labels", "quality", "quality"), ("customer", "c_name", "name")]
    frames = [profile.task_type(table(spark, sf, t), c).select(F.lit(n).alias("label"), "distinct_labels", "task_type")
              for t, c, n in parts]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("WITH " + fx.FAULTED_SQL + " SELECT coalesce(o_orderpriority, '<missing>') || ' | ' || o_orderstatus AS sample_id, count(*) AS n FROM faulted GROUP BY 1")
def composite_sample_id(spark, sf):
    return profile.sample_ids(fx.faulted_orders(spark, sf), ["o_orderpriority", "o_orderstatus"]).groupBy(
        "sample_id").agg(F.count(F.lit(1)).alias("n"))


# labels

@query("WITH " + fx.DOC_SQL + """, c AS (SELECT quality AS label, count(*) AS n FROM doc GROUP BY 1)
SELECT CAST(label AS VARCHAR) AS label, n, (SELECT count(label) FROM c) AS label_cardinality,
  round(1 - (SELECT sum(n) FROM c WHERE label IS NOT NULL) / (SELECT sum(n) FROM c), 6) AS label_missing_rate,
  round(n / (SELECT sum(n) FROM c WHERE label IS NOT NULL), 6) AS share FROM c WHERE label IS NOT NULL""")
def label_stats(spark, sf):
    return quality.label_stats(fx.doc_labels(spark, sf), "quality")


_BALANCE = """, c AS (SELECT {c} AS v, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1),
s AS (SELECT v, n, n / (SELECT sum(n) FROM c) AS share FROM c),
e AS (SELECT count(*) AS k, -sum(share * ln(share)) AS h, min(n) AS lo, max(n) AS hi FROM s)
SELECT k AS num_classes, round(h, 6) AS entropy, round(h / ln(k), 6) AS normalized_entropy,
  round(exp(h), 6) AS effective_number, lo AS min_class_count, hi AS max_class_count FROM e"""


@query("WITH z AS (SELECT 1)" + _BALANCE.format(c="label", t="embeddings"))
def class_balance(spark, sf):
    return quality.class_balance(table(spark, sf, "embeddings"), "label")


@query("WITH " + fx.ANNOTATION_SQL + """, r AS (SELECT (a1 IS NOT NULL OR a2 IS NOT NULL OR a3 IS NOT NULL) AS rated,
  (a1 = a2 AND (a3 IS NULL OR a3 = a1)) AS agree FROM ann)
SELECT count(*) FILTER (rated) AS rows_with_any_label, round(avg(CASE WHEN rated THEN agree::INT END), 6) AS exact_agreement_rate,
  round(avg((rated AND NOT agree)::INT), 6) AS disagreement_rate FROM r""")
def annotator_agreement(spark, sf):
    return quality.annotator_agreement(fx.annotations(spark, sf), ["a1", "a2", "a3"])


def _kappa_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS annotator_a, '{b}' AS annotator_b, count(*) AS n_items, avg(({a} = {b})::INT) AS po, "
            f"avg({a}) * avg({b}) + (1 - avg({a})) * (1 - avg({b})) AS pe FROM ann WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


@query("WITH " + fx.ANNOTATION_SQL + ", p AS (" + " UNION ALL ".join(
    [_kappa_sql("a1", "a2"), _kappa_sql("a1", "a3"), _kappa_sql("a2", "a3")]) +
    "), k AS (SELECT *, (po - pe) / (1 - pe) AS kappa FROM p) SELECT annotator_a, annotator_b, n_items, "
    "round(kappa, 6) AS kappa, round((SELECT avg(kappa) FROM k), 6) AS mean_kappa FROM k")
def cohen_kappa(spark, sf):
    return quality.cohen_kappa(fx.annotations(spark, sf), ["a1", "a2", "a3"])


@query("""WITH e AS (SELECT '.' || regexp_extract(url, '//[^/]+/([^/]+)/', 1) AS extension FROM pages),
c AS (SELECT extension, count(*) AS n FROM e GROUP BY 1)
SELECT extension, n, extension IN ('.en', '.fr') AS allowed,
  round((SELECT sum(n) FROM c WHERE extension IN ('.en', '.fr')) / (SELECT sum(n) FROM c), 6) AS format_conformance_rate FROM c""")
def format_conformance(spark, sf):
    ext = F.concat(F.lit("."), F.regexp_extract("url", "//[^/]+/([^/]+)/", 1))
    return quality.format_conformance(table(spark, sf, "pages"), ext, [".en", ".fr"])


# duplicates and leakage

@query("WITH " + fx.FAULTED_SQL + """, d AS (SELECT DISTINCT * FROM faulted)
SELECT (SELECT count(*) FROM faulted) AS rows, (SELECT count(*) FROM faulted) - count(*) AS duplicate_rows,
  round(1 - count(*) / (SELECT count(*) FROM faulted), 6) AS duplicate_rate FROM d""")
def duplicate_rows(spark, sf):
    return dedup.duplicate_rate(fx.faulted_orders(spark, sf))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT (SELECT count(*) FROM lineitem) AS rows, (SELECT count(*) FROM lineitem) - count(*) AS duplicate_rows,
  round(1 - count(*) / (SELECT count(*) FROM lineitem), 6) AS duplicate_rate FROM d""")
def duplicate_ids(spark, sf):
    return dedup.duplicate_rate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


_CONTENT = """, g AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  count(DISTINCT split) AS k, count(*) AS n FROM faulted GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("WITH " + fx.FAULTED_SQL + _CONTENT + """ SELECT count(*) AS num_contents, count(*) FILTER (k > 1) AS leaked_contents,
  round(avg((k > 1)::INT), 6) AS leakage_rate FROM g""")
def split_leakage(spark, sf):
    return dedup.split_leakage(fx.faulted_orders(spark, sf), "split")


@query("WITH " + fx.FAULTED_SQL + _CONTENT + """ SELECT CAST(sum(n) AS BIGINT) AS rows, round((sum(n) - (SELECT count(*) FROM (SELECT DISTINCT * FROM faulted))) / sum(n), 6) AS duplicate_rate,
  round(avg((k > 1)::INT), 6) AS leakage_rate FROM g""")
def duplicates_and_leakage(spark, sf):
    return dedup.duplicates_and_leakage(fx.faulted_orders(spark, sf), "split")


@query("WITH " + fx.DOC_SQL + """, p AS (SELECT text, split, count(*) AS n FROM doc GROUP BY 1, 2),
h AS (SELECT text, sum(n) AS n, count(*) AS k FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS total_items, CAST(coalesce(sum(n) FILTER (k > 1), 0) AS BIGINT) AS leaked_items,
  count(*) FILTER (k > 1) AS leaked_hashes, round(coalesce(sum(n) FILTER (k > 1), 0) / sum(n), 6) AS leakage_rate FROM h""")
def item_leakage(spark, sf):
    return dedup.item_leakage(fx.doc_labels(spark, sf), F.col("text"), "split")


@query("WITH " + fx.DOC_SQL + """ SELECT doc_id, lang, split FROM doc WHERE text IN
  (SELECT text FROM doc GROUP BY text HAVING count(DISTINCT split) > 1)""")
def leaked_items(spark, sf):
    return dedup.leaked_items(fx.doc_labels(spark, sf), F.col("text"), "split").select("doc_id", "lang", "split")


@query("WITH " + fx.DOC_SQL + """, h AS (SELECT text, count(DISTINCT lang || source) AS k FROM doc GROUP BY 1)
SELECT count(*) AS hash_groups, count(*) FILTER (k > 1) AS conflict_groups, round(avg((k > 1)::INT), 6) AS conflict_rate FROM h""")
def label_conflicts(spark, sf):
    docs = fx.doc_labels(spark, sf).withColumn("tag", F.concat("lang", "source"))
    return dedup.label_conflicts(docs, F.col("text"), "tag")


@query("""WITH h AS (SELECT text, count(*) AS n FROM documents GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS unique_hashes, count(*) FILTER (n > 1) AS duplicated_hashes,
  CAST(sum(n - 1) AS BIGINT) AS duplicate_items, round(sum(n - 1) / sum(n), 6) AS duplicate_rate FROM h""")
def content_hash_duplicates(spark, sf):
    return dedup.content_duplicates(table(spark, sf, "documents"), F.col("text"))


@query("SELECT sha256(text) AS hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, hash LIMIT 10")
def top_duplicate_hashes(spark, sf):
    return dedup.top_duplicates(table(spark, sf, "documents"), F.col("text"))


def _fingerprints(spark, sf):
    """The hash column as a scan would store it: computed once, then read."""
    return materialized(spark, f"fingerprints:{sf}", lambda: fx.text_fingerprints(spark, sf), (table(spark, sf, "documents"),))


_NEAR = "WITH " + fx.FINGERPRINT_SQL + """, p AS (SELECT a.phash AS hash_a, b.phash AS hash_b,
  CAST(bit_count(xor(('0x' || a.phash)::UBIGINT, ('0x' || b.phash)::UBIGINT)) AS BIGINT) AS hamming
  FROM fp a JOIN fp b ON substr(a.phash, 1, 4) = substr(b.phash, 1, 4) AND a.doc_id < b.doc_id),
f AS (SELECT least(hash_a, hash_b) AS hash_a, greatest(hash_a, hash_b) AS hash_b, hamming FROM p WHERE hamming <= 6)"""


@query(_NEAR.replace("substr(a.phash, 1, 4) = substr(b.phash, 1, 4) AND ", "") + " SELECT count(*) AS near_duplicate_pairs, count(DISTINCT hash_a || hash_b) AS hash_pairs, (SELECT count(*) FROM fp) AS hashed_items FROM f")
def near_duplicates(spark, sf):
    return dedup.near_duplicates(_fingerprints(spark, sf), "doc_id", "phash", 6)


@query(_NEAR + " SELECT hash_a, hash_b, hamming, count(*) AS item_pairs FROM f GROUP BY 1, 2, 3")
def near_duplicate_pairs(spark, sf):
    return dedup.near_duplicate_pairs(_fingerprints(spark, sf), "doc_id", "phash", 6).select(
        "hash_a", "hash_b", "hamming", "item_pairs")


_CLUSTERS = "WITH RECURSIVE " + _NEAR.removeprefix("WITH ") + """, h AS (SELECT DISTINCT phash AS h FROM fp),
e AS (SELECT hash_a AS x, hash_b AS y FROM f UNION SELECT hash_b, hash_a FROM f UNION SELECT h, h FROM h),
reach AS (SELECT h AS root, h AS node FROM h UNION SELECT r.root, e.y FROM reach r JOIN e ON r.node = e.x),
named AS (SELECT node AS hash, min(root) AS cluster FROM reach GROUP BY 1), it AS (SELECT doc_id, phash AS hash, cluster FROM fp JOIN named ON fp.phash = named.hash),
cl AS (SELECT cluster, min(doc_id) AS representative, count(*) AS cluster_items FROM it GROUP BY 1)"""


@query(_CLUSTERS + " SELECT doc_id, hash, cluster, representative, cluster_items FROM it JOIN cl USING (cluster)")
def near_duplicate_clusters(spark, sf):
    """Every item with its cluster of near duplicates: as many rows as items."""
    return clusters.clustered_items(_fingerprints(spark, sf), "doc_id", "phash", 6).withColumnRenamed("item", "doc_id")


@query(_CLUSTERS + """ SELECT (SELECT count(*) FROM fp) AS hashed_items, count(*) FILTER (cluster_items > 1) AS clusters,
  CAST(coalesce(sum(cluster_items) FILTER (cluster_items > 1), 0) AS BIGINT) AS clustered_items, max(cluster_items) AS largest_cluster,
  (SELECT count(*) FROM f) AS near_duplicate_pairs, (SELECT count(DISTINCT hash_a || hash_b) FROM f) AS hash_pairs FROM cl""")
def near_duplicate_summary(spark, sf):
    return clusters.cluster_summary(clusters.near_duplicate_clusters(_fingerprints(spark, sf), "doc_id", "phash", 6))


@query("""SELECT * FROM (VALUES ('o_orderkey', 'shared', 'bigint', 'bigint'), ('o_custkey', 'type_changed', 'bigint', 'string'),
  ('o_orderstatus', 'only_baseline', 'string', NULL), ('o_totalprice', 'shared', 'double', 'double'),
  ('o_orderdate', 'shared', 'timestamp_ntz', 'timestamp_ntz'), ('o_orderpriority', 'shared', 'string', 'string'),
  ('o_new', 'only_candidate', NULL, 'bigint')) AS t("column", status, dtype_a, dtype_b) WHERE (SELECT count(*) FROM orders) > 0""")
def schema_delta(spark, sf):
    return dedup.schema_delta(*fx.order_halves(spark, sf))


@query("""WITH s AS (SELECT DISTINCT 'd' || doc_id AS stem FROM documents), a AS (SELECT DISTINCT 'd' || doc_id AS stem FROM labels)
SELECT count(*) AS total_assets, count(a.stem) AS linked_assets, round(count(a.stem) / count(*), 6) AS linkage_rate FROM s LEFT JOIN a USING (stem)""")
def annotation_linkage(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("img/d"), "doc_id", F.lit(".png")).alias("path"))
    notes = table(spark, sf, "labels").select(F.concat(F.lit("ann/d"), "doc_id", F.lit(".txt")).alias("path"))
    return dedup.annotation_linkage(docs, notes)


@query("SELECT 'd' || doc_id AS stem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY stem LIMIT 20")
def unmatched_assets(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("img/d"), "doc_id", F.lit(".png")).alias("path"))
    notes = table(spark, sf, "labels").select(F.concat(F.lit("ann/d"), "doc_id", F.lit(".txt")).alias("path"))
    return dedup.unmatched_assets(docs, notes)


@query("SELECT CAST(d.source AS VARCHAR) AS source, count(*) AS n, count(l.doc_id) AS joined FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def metadata_join_by_path(spark, sf):
    meta = table(spark, sf, "documents").select("source", F.concat(F.lit("a/"), "doc_id").alias("file"))
    assets = table(spark, sf, "labels").select(F.concat(F.lit("a/"), "doc_id").alias("path"), "quality")
    return dedup.join_metadata(meta, assets, "file").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("_asset_path").alias("joined"))


@query("""WITH a AS (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE quality = 1)
SELECT d.source, count(*) AS n, count(a.doc_id) AS joined FROM documents d LEFT JOIN a USING (doc_id) GROUP BY 1""")
def metadata_join_by_name(spark, sf):
    meta = table(spark, sf, "documents").select("source", F.concat(F.lit("x/y/"), "doc_id").alias("file"))
    labels = table(spark, sf, "labels")
    assets = labels.select(F.concat(F.lit("a/"), "doc_id").alias("path")).unionByName(
        labels.filter("quality = 1").select(F.concat(F.lit("b/"), "doc_id").alias("path")))
    return dedup.join_metadata_by_name(meta, assets, "file").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("_asset_path").alias("joined"))
