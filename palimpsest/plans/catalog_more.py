"""Further registered queries: sources, tools, streams and the operators that scenarios are made of."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions import code, text as fn, vector
from palimpsest.operators import aggregates, blobs as bl, cluster, fulltext, lexical, scans, search, symbols, tree, versions as ve
from palimpsest.plans import mapping as m
from palimpsest.plans.catalog import registered
from palimpsest.plans.mapping import BLOBS, EMBEDDINGS, INODES, QUERY, VERSIONS
from palimpsest.session import new_folder, table
from palimpsest.sources import documents, stores
from palimpsest.streaming import consolidate, queue


# sources


@registered("sc09_blocks_of_version", sql="SELECT doc_id AS start_line, lang AS kind FROM documents WHERE source = 'src3' ORDER BY doc_id")
def _(spark, d):
    nodes = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("version_id"), F.col("doc_id").alias("start_line"), F.col("lang").alias("kind"))
    return scans.blocks_of_version(nodes, "src3").select("start_line", "kind")


@registered("sc14_models", sql="SELECT r_regionkey AS id, r_name AS name, 64 AS dimensions FROM region WHERE r_regionkey = 2")
def _(spark, d):
    models = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(64).alias("dimensions"), (F.col("r_regionkey") == 2).alias("is_default"))
    by_name = scans.model_by_name(models, scans.default_model(models).first().name)
    return by_name.select("id", "name", "dimensions")


@registered("sc18_check_schema", sql="SELECT * FROM (VALUES ('missing table inode_registry'), ('missing table storage_backends'), ('forbidden column blobs.refcount')) AS t(problem)")
def _(spark, d):
    found = {"blobs": schema.conform(m.blobs(spark, d), "blobs").withColumn("refcount", F.lit(1)), "file_versions": schema.conform(m.versions(spark, d), "file_versions")}
    return spark.createDataFrame([(p,) for p in schema.check_schema(found)], "problem string")


@registered("sc22_import_indexed")
def _(spark, d):
    """All files of the folder of tables, hashed where they are."""
    return stores.import_indexed(stores.read_directory(spark, d)).select("name", "size", "content_hash", F.col("blob_id").isNull().alias("in_place"))


@registered("sc22_import_copied", sql="SELECT doc_id AS id, sha256(text) AS content_hash, CAST(min(doc_id) OVER (PARTITION BY sha256(text)) AS VARCHAR) AS blob_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS stored FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    told = bl.dedup_contents(docs, "doc_id", "text")
    packed = bl.pack(docs, "doc_id", "text").select("id", "stored")
    return told.join(packed, "id").select("id", "content_hash", F.col("canonical_id").cast("string").alias("blob_id"), F.when(F.col("inserted"), F.col("stored")).isNotNull().alias("stored"))


@registered("sc23_sc24_markers", VERSIONS, sql="SELECT id AS seq, CAST(inode_id AS VARCHAR) AS inode_id, content_hash FROM fv")
def _(spark, d):
    rows = m.versions(spark, d).select(F.col("id").alias("seq"), F.col("inode_id").cast("string"), F.col("id").cast("string").alias("version_id"), "content_hash", "size")
    path = new_folder(spark, "markers")
    queue_rows = schema.conform(rows, "pending_markers")
    documents.write_markers(queue_rows, path)
    return spark.read.schema(schema.schema_of("pending_markers")).json(path).select("seq", "inode_id", "content_hash")


@registered("sc25_wordnet", sql="SELECT lower(n_name) AS lemma, 'n' AS pos, 'en' AS language FROM nation")
def _(spark, d):
    path = new_folder(spark, "wordnet")
    nodes = F.collect_list(F.struct(F.lower("n_name").alias("lemma"), F.lit("n").alias("pos"), F.lit(None).cast("string").alias("external_ref")))
    table(spark, d, "nation").agg(nodes.alias("nodes")).select(F.lit("en").alias("language"), "nodes", F.expr("cast(array() as array<struct<`from`:string,`to`:string,relation:string>>)").alias("edges")).write.json(path)
    return documents.read_wordnet(spark, path)[0].select("lemma", "pos", "language")


@registered("sc26_plugin_types", sql="SELECT * FROM (VALUES ('generic', FALSE), ('png', FALSE), ('rust', TRUE)) AS t(type, ast)")
def _(spark, d):
    return documents.list_plugin_types(spark).select("type", "ast")


def _rust_files(spark, d):
    """A source file for each document: two public functions, one of them with an id."""
    i = F.col("doc_id").cast("string")
    mark = F.concat(F.lpad(F.hex(F.col("doc_id")), 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    source = F.concat(F.lit("/// @id: "), mark, F.lit("\n/// Does it.\npub fn f"), i, F.lit("() {}\n\npub fn g"), i, F.lit("() {}\n"))
    return table(spark, d, "documents").select(F.concat(F.lit("crates/"), F.col("source"), F.lit("/src/"), i, F.lit(".rs")).alias("path"), source.alias("source"), F.lower(mark).alias("id"), "doc_id")


@registered("sc27_fn16_symbols", sql="SELECT 'crates/' || source || '/src/' || doc_id || '.rs' AS path, 'f' || doc_id AS name, 3 AS line, 'Does it.' AS doc_summary FROM documents UNION ALL SELECT 'crates/' || source || '/src/' || doc_id || '.rs', 'g' || doc_id, 5, NULL FROM documents")
def _(spark, d):
    return symbols.scan_symbols(_rust_files(spark, d)).select("path", "name", "line", "doc_summary")


# predicates and sets


@registered("fi01_null_safe", sql="SELECT count(*) FILTER (WHERE a IS NOT DISTINCT FROM b) AS same, count(*) FILTER (WHERE a IS DISTINCT FROM b) AS other FROM (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 3 END AS a, CASE WHEN o_custkey % 2 > 0 THEN 1 END AS b FROM orders)")
def _(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3).alias("a"), F.when(F.col("o_custkey") % 2 > 0, 1).alias("b"))
    return o.agg(F.count_if(fn.same(F.col("a"), F.col("b"))).alias("same"), F.count_if(~fn.same(F.col("a"), F.col("b"))).alias("other"))


@registered("fi02_optional", VERSIONS, sql="SELECT 'all' AS asked, count(*) AS n FROM fv UNION ALL SELECT 'click', count(*) FROM fv WHERE special_type = 'click'")
def _(spark, d):
    v = m.versions(spark, d)
    one = lambda kind: v.where(fn.optional(None if kind is None else F.col("special_type") == kind)).agg(F.lit(kind or "all").alias("asked"), F.count("*").alias("n"))
    return one(None).union(one("click"))


@registered("fi13_partial_update", INODES, sql="SELECT id, CASE WHEN id = 'c9' THEN 4242 ELSE size END AS size, name FROM inodes")
def _(spark, d):
    return tree.set_attributes(m.inodes(spark, d), "c9", size=4242, name=None).select("id", "size", "name")


@registered("se01_union_all", sql="SELECT 'document' AS kind, doc_id AS id FROM documents WHERE lang = 'de' UNION ALL SELECT 'page', page_id FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    docs = table(spark, d, "documents").where("lang = 'de'").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return docs.unionByName(table(spark, d, "pages").where("page_id % 2 = 0").select(F.lit("page").alias("kind"), F.col("page_id").alias("id")))


@registered("se02_union", sql="SELECT doc_id FROM documents WHERE lang = 'de' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def _(spark, d):
    return table(spark, d, "documents").where("lang = 'de'").select("doc_id").union(table(spark, d, "labels").where("toxic = 1").select("doc_id")).distinct()


@registered("se03_except", sql="SELECT lang, source FROM documents WHERE doc_id % 7 <> 1 EXCEPT SELECT lang, source FROM documents WHERE doc_id % 7 = 1")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("doc_id % 7 <> 1").select("lang", "source").subtract(docs.where("doc_id % 7 = 1").select("lang", "source"))


# joins and aggregates


@registered("jo01_named_versions", VERSIONS, sql="SELECT id, c_name AS name FROM fv JOIN customer ON c_custkey = inode_id WHERE status = 'clean'")
def _(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("inode_id"), F.col("c_name").alias("name"))
    return m.versions(spark, d).where("status = 'clean'").join(names, "inode_id").select("id", "name")


@registered("jo13_refresh_current", VERSIONS, sql="SELECT e.id, v.version_number = l.last AS is_current FROM fv v JOIN (SELECT inode_id, max(version_number) AS last FROM fv GROUP BY inode_id) l USING (inode_id) JOIN (SELECT id FROM fv) e ON e.id = v.id")
def _(spark, d):
    v = m.versions(spark, d)
    nodes = v.select(F.col("id"), F.col("id").alias("version_id"))
    stale = v.select("id", (F.col("id") % 2 == 0).alias("is_current"))
    return ve.refresh_is_current(stale, nodes, v)


@registered("jo15_backfill", VERSIONS, sql="SELECT e.vec_id AS id, coalesce(fv.special_type, 'generic') AS plugin_type FROM embeddings e LEFT JOIN fv ON fv.id = e.vec_id")
def _(spark, d):
    kinds = m.versions(spark, d).select("id", "special_type")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id")).join(kinds, "id", "left").select("id", F.coalesce("special_type", F.lit("generic")).alias("plugin_type"))


@registered("ag19_variance", sql="SELECT c_mktsegment, round(var_samp(c_acctbal) / 1e6, 6) AS variance FROM customer GROUP BY c_mktsegment")
def _(spark, d):
    stats = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), (F.var_pop("c_acctbal") * F.count("*")).alias("m2"))
    return stats.select("c_mktsegment", F.round(vector.sample_variance(F.col("m2"), F.col("n")) / 1e6, 6).alias("variance"))


@registered("ag12_spans", VERSIONS, sql="SELECT inode_id, min(version_number) AS lo, max(version_number) AS hi, count(*) AS n FROM fv GROUP BY inode_id")
def _(spark, d):
    return m.versions(spark, d).groupBy("inode_id").agg(F.min("version_number").alias("lo"), F.max("version_number").alias("hi"), F.count("*").alias("n"))


@registered("ag14_listed", sql="SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY n_regionkey")
def _(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


# search tools


@registered("tk05_merge_hits", EMBEDDINGS, QUERY, "near AS (SELECT id, consolidated, 1 - list_cosine_similarity(embedding, v) AS d FROM emb, q), old AS (SELECT id, d FROM near WHERE consolidated ORDER BY d, id LIMIT 15), new AS (SELECT id, d FROM near WHERE NOT consolidated OR id % 2 = 0 ORDER BY d, id LIMIT 15)", sql="SELECT id, round(min(d), 6) AS distance, CASE WHEN bool_or(s = 0) THEN 'crystallised' ELSE 'buffered' END AS source FROM (SELECT id, d, 0 AS s FROM old UNION ALL SELECT id, d, 1 FROM new) GROUP BY id ORDER BY min(d), id LIMIT 10")
def _(spark, d):
    """Hits of the consolidated vectors and of the others, some in both lists."""
    e, v = m.embeddings(spark, d), m.query_vector(spark, d)
    old = search.nearest(e.where("consolidated"), v, 15)
    new = search.nearest(e.where("not consolidated or id % 2 = 0"), v, 15)
    return search.merge_hits(old, new, 10).withColumn("distance", F.round("distance", 6))


@registered("sr05_search_semantic", EMBEDDINGS, QUERY, sql="SELECT id, round(1 - list_cosine_similarity(embedding, v), 6) AS distance FROM emb, q WHERE plugin_type = 't2' ORDER BY 1 - list_cosine_similarity(embedding, v), id LIMIT 10")
def _(spark, d):
    hits = search.search_semantic(m.centroids(spark, d), m.members(spark, d), m.embeddings(spark, d), query_vector=m.query_vector(spark, d), type_filter="t2")
    return hits.select("id", F.round("distance", 6).alias("distance"))


@registered("sr06_search_functions", EMBEDDINGS, QUERY, sql="SELECT id, round(1 - list_cosine_similarity(embedding, v), 6) AS distance FROM emb, q WHERE plugin_type = 't3' AND id % 2 = 0 ORDER BY 1 - list_cosine_similarity(embedding, v), id LIMIT 10")
def _(spark, d):
    nodes = m.embeddings(spark, d).select("id", F.when(F.col("id") % 2 == 0, "function").otherwise("struct").alias("kind"), F.col("id").cast("string").alias("name"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))
    hits = search.search_functions(m.centroids(spark, d), m.members(spark, d), m.embeddings(spark, d), nodes, m.query_vector(spark, d), "t3", "function")
    return hits.select("id", F.round("distance", 6).alias("distance"))


@registered("sr07_browse_fallback", EMBEDDINGS, sql="SELECT DISTINCT plugin_type, TRUE AS calibrated_only FROM emb WHERE CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 0")
def _(spark, d):
    return search.browse_concepts(m.centroids(spark, d).withColumn("is_active", F.lit(False)), m.thresholds(spark, d)).select("plugin_type", "calibrated_only")


@registered("sr10_ranked_tools", sql="SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])license([^\\p{L}\\p{N}]|$)')")
def _(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("inode_id"), F.lit("generic").alias("special_type"), F.col("text").alias("search_text"))
    names = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    nodes = docs.limit(0).select(F.col("doc_id").alias("id"), F.col("doc_id").alias("version_id"), F.lit("").alias("kind"), F.lit("").alias("name"), F.col("text").alias("source"))
    return fulltext.search_fulltext(v, nodes, names, "license", limit=1_000_000).select("id")


@registered("sr12_sharded_search", EMBEDDINGS, QUERY, sql="SELECT id, round(1 - list_cosine_similarity(embedding, v), 6) AS distance FROM emb, q ORDER BY 1 - list_cosine_similarity(embedding, v), id LIMIT 25")
def _(spark, d):
    shards = [search.nearest(m.embeddings(spark, d).where(F.col("id") % 3 == k), m.query_vector(spark, d), 25).select("id", "distance") for k in range(3)]
    return shards[0].union(shards[1]).union(shards[2]).orderBy("distance", "id").limit(25).select("id", F.round("distance", 6).alias("distance"))


@registered("sr13_file_content", sql="SELECT doc_id AS id, CASE WHEN doc_id % 4 > 0 THEN text END AS text, CASE WHEN doc_id % 4 = 0 THEN '/v8=' END AS bytes_base64 FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    data = F.when(F.col("doc_id") % 4 == 0, F.lit(b"\xfe\xff")).otherwise(F.col("text").cast("binary"))
    stored = docs.select(F.col("doc_id").alias("blob_id"), fn.compress(data).alias("data"))
    return stores.file_content(docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("blob_id")), stored)


@registered("sr14_cat", sql="SELECT doc_id AS id, sha256(text) AS content_hash FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("blob_id"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("ext/"), F.col("doc_id").cast("string"))).alias("external_path"))
    stored = docs.select(F.col("doc_id").alias("blob_id"), fn.compress(F.col("text").cast("binary")).alias("data"))
    raw = docs.select(F.concat(F.lit("ext/"), F.col("doc_id").cast("string")).alias("external_path"), F.col("text").cast("binary").alias("data"))
    return stores.cat(v, stored, raw).select("id", fn.content_hash(F.col("data")).alias("content_hash"))


@registered("sr15_file_history", VERSIONS, sql="SELECT id, version_number FROM fv WHERE inode_id = 3 ORDER BY version_number")
def _(spark, d):
    nodes = m.inodes(spark, d)
    home = tree.with_paths(nodes).where("id = 'c3'").first().path
    inode = int(tree.must_resolve(nodes, home).id[1:])
    return scans.history(m.versions(spark, d), inode).select("id", "version_number")


# clustering


@registered("cl06_split")
def _(spark, d):
    e = m.embeddings(spark, d).select("id", "plugin_type", "embedding").where("consolidated")
    import pandas as pd

    def halves(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("id")
        parts = cluster.split_in_two(rows["id"].astype(str).tolist(), np.stack(rows["embedding"].to_list()))
        return pd.DataFrame([(rows["plugin_type"].iloc[0], k, p.count, round(p.m2, 4)) for k, p in enumerate(parts)], columns=["plugin_type", "half", "members", "m2"])

    return e.groupBy("plugin_type").applyInPandas(halves, "plugin_type string, half int, members long, m2 double")


@registered("cl09_mark_consolidated", EMBEDDINGS, sql="SELECT plugin_type, count(*) AS waiting FROM emb WHERE NOT consolidated AND CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 1 GROUP BY plugin_type UNION ALL SELECT plugin_type, count(*) - 25 FROM emb WHERE NOT consolidated AND CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 0 GROUP BY plugin_type HAVING count(*) > 25")
def _(spark, d):
    e = m.embeddings(spark, d)
    state = cluster.consolidate_batch(e, m.thresholds(spark, d), cluster.empty_state(spark))
    return cluster.buffered_after(e, state).where("not consolidated").groupBy("plugin_type").agg(F.count("*").alias("waiting"))


@registered("cl10_due", EMBEDDINGS, "b AS (SELECT plugin_type, CAST(substring(plugin_type, 2) AS INTEGER) AS t, count(*) FILTER (WHERE NOT consolidated) AS backlog FROM emb GROUP BY plugin_type)", sql="SELECT plugin_type, after FROM b, (VALUES (0), (100), (1000)) AS w(after) WHERE t % 2 = 0 AND (backlog >= CASE WHEN t % 4 = 0 THEN 5 ELSE 1000000 END OR after >= 1000 OR (backlog > 0 AND after >= 100))")
def _(spark, d):
    """Combinations that are due at once (a long backlog), after an idle time, and after the longest wait."""
    e = m.embeddings(spark, d)
    limits = m.thresholds(spark, d).withColumns({"backlog_threshold": F.when(F.substring("plugin_type", 2, 9).cast("int") % 4 == 0, 5).otherwise(1_000_000).cast("long"), "idle_before_sleep_secs": F.lit(100), "max_wait_secs": F.lit(1000)})
    now = [0.0]
    watch = consolidate.Supervisor(lambda: limits, lambda: now[0])
    rows = []
    for now[0] in (0.0, 100.0, 1000.0):
        rows += [(plugin_type, int(now[0])) for plugin_type, _ in watch.due(e)]
    return spark.createDataFrame(rows, "plugin_type string, after int")


@registered("cl11_supervised", EMBEDDINGS, "b AS (SELECT plugin_type, count(*) AS backlog FROM emb WHERE NOT consolidated AND CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 0 GROUP BY plugin_type)", sql="SELECT plugin_type, CAST(ceil(backlog / 25) AS BIGINT) AS cycles, backlog AS members FROM b")
def _(spark, d):
    """Cycles until no calibrated combination is due: each takes its batches of 25, until none waits."""
    e, now = m.embeddings(spark, d), [0.0]
    limits = m.thresholds(spark, d).withColumns({"backlog_threshold": F.lit(1).cast("long"), "batch_size": F.lit(25)})
    watch, state = consolidate.Supervisor(lambda: limits, lambda: now[0]), cluster.empty_state(spark)
    while True:
        state, ran = watch.cycle(cluster.buffered_after(e, state), state)
        if not ran:
            break
    members = cluster.members_of(state).join(cluster.centroids_of(state).select(F.col("id").alias("centroid_id"), "plugin_type"), "centroid_id").groupBy("plugin_type").agg(F.count("*").alias("members"))
    cycles = spark.createDataFrame([(k[0], n) for k, n in watch.cycles.items()], "plugin_type string, cycles long")
    return cycles.join(members, "plugin_type").select("plugin_type", "cycles", "members")


@registered("cl12_set_threshold", EMBEDDINGS, sql="SELECT DISTINCT plugin_type, CASE WHEN plugin_type = 't2' THEN 0.42 ELSE 0.8 END AS join_threshold FROM emb WHERE CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 0 UNION ALL SELECT 'fresh', 0.1")
def _(spark, d):
    t = schema.conform(m.thresholds(spark, d), "consolidation_thresholds")
    return cluster.set_threshold(cluster.set_threshold(t, "t2", "m", 0.42), "fresh", "m", 0.1).select("plugin_type", "join_threshold")


@registered("cl13_lock_keys", sql="SELECT * FROM (VALUES ('', -1477818771), ('a', 1075015857), ('ab', 1718550461), ('abc', -785388649), ('abcd', -393934804), ('abcde', -445659580)) AS t(text, key)")
def _(spark, d):
    return spark.createDataFrame([("abcde"[:n],) for n in range(6)], "text string").select("text", fn.lock_key(F.col("text")).cast("long").alias("key"))


# text and code


@registered("fn03_pack", sql="SELECT doc_id AS id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, TRUE AS packed FROM documents")
def _(spark, d):
    return bl.pack(table(spark, d, "documents"), "doc_id", "text").select("id", "content_hash", "size", (F.col("compressed_size") > 0).alias("packed"))


@registered("fn10_blocks_general", sql="SELECT doc_id, 'function' AS kind, 'p' || doc_id AS name, 1 AS start_line, 2 AS end_line FROM documents UNION ALL SELECT doc_id, 'class', 'C', 4, 6 FROM documents")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    source = F.concat(F.lit("def p"), i, F.lit("(x):\n    return x\n\nclass C:\n    def __init__(self):\n        pass\n"))
    rows = table(spark, d, "documents").select("doc_id", F.explode(code.code_blocks_general(source, F.lit("python"))).alias("b"))
    return rows.select("doc_id", "b.kind", "b.name", "b.start_line", "b.end_line")


@registered("fn12_block_hashes", sql="SELECT doc_id, sha256('fn f' || doc_id || '() {}') AS content_hash FROM documents")
def _(spark, d):
    source = F.concat(F.lit("fn f"), F.col("doc_id").cast("string"), F.lit("() {}"))
    return table(spark, d, "documents").select("doc_id", F.element_at(code.code_blocks(source, F.lit("rust")), 1)["content_hash"].alias("content_hash"))


@registered("fn14_json_strings", sql="SELECT event_id, 'x' || event_type || ' y' AS strings FROM events")
def _(spark, d):
    j = F.concat(F.lit('{"z": "y", "a": {"b": ["x'), F.col("event_type"), F.lit('", 3]}}'))
    return table(spark, d, "events").select("event_id", fn.json_strings(j).alias("strings"))


@registered("fn21_hex", sql="SELECT n_nationkey, lower(hex(encode(n_name))) AS hex FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", fn.hex_encode(F.col("n_name")).alias("hex"))


@registered("fn23_paths", sql="SELECT doc_id, 'crates/' || source || '/src/' || doc_id || '.rs' AS path, source AS crate, 'T' || doc_id AS target FROM documents")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    path = F.concat(F.lit("/home/x/crates/"), F.col("source"), F.lit("/src/"), i, F.lit(".rs"))
    head = F.concat(F.lit("impl<A: B> Show for T"), i, F.lit("<A> {"))
    return table(spark, d, "documents").select("doc_id", fn.normalize_path(path).alias("path"), fn.crate_of(path).alias("crate"), fn.impl_target(head).alias("target"))


@registered("fn25_age", sql="SELECT event_id, (epoch_ms(TIMESTAMP '2024-02-01') - epoch_ms(date_trunc('second', ts))) / 1000 AS age FROM events")
def _(spark, d):
    created = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", fn.age_seconds(created, F.lit(datetime(2024, 2, 1))).alias("age"))


@registered("fn26_entries", sql="SELECT l_orderkey, l_linenumber, greatest(1024, least(100000, CAST(floor(l_extendedprice * 100000 / 64 / 256) AS BIGINT))) AS entries FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fn.entries_for_memory(F.col("l_extendedprice") * 100000).cast("long").alias("entries"))


# tree and versions


@registered("ve02_create_delete", INODES, VERSIONS, sql="SELECT (SELECT count(*) FROM inodes) AS inodes, (SELECT count(*) FROM fv WHERE inode_id <> 4) AS versions, (SELECT max(ino) + 1 FROM inodes) AS new_ino")
def _(spark, d):
    nodes = schema.conform(m.inodes(spark, d), "inode_registry")
    made = tree.create_inode(nodes, "root", "new", "new-id")
    v = m.versions(spark, d)
    out = tree.delete_cascade(made.withColumn("id", F.regexp_replace("id", "^c", "")), spark.createDataFrame([("4",)], "id string"), v.withColumn("inode_id", F.col("inode_id").cast("string")), {})
    new_ino = made.where("id = 'new-id'").agg(F.max("ino").alias("new_ino"))
    return out["inode_registry"].agg(F.count("*").alias("inodes")).crossJoin(out["file_versions"].agg(F.count("*").alias("versions"))).crossJoin(new_ino)


@registered("ve03_rename", INODES, sql="SELECT id, CASE WHEN id = 'c5' THEN 'n1' ELSE parent_id END AS parent_id, CASE WHEN id = 'c5' THEN 'moved' ELSE name END AS name FROM inodes")
def _(spark, d):
    return tree.rename(m.inodes(spark, d), "c5", "n1", "moved")[0].select("id", "parent_id", "name")


@registered("ve04_touch", sql="SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'touched' ELSE 'left' END AS state FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("atime"))
    now = datetime(2030, 1, 1)
    return tree.touch_access(o, 7, now, F.lit(True)).select("id", F.when(F.year("atime") == 2030, "touched").otherwise("left").alias("state"))


@registered("dd02_sizes", BLOBS, sql="SELECT blob_id, CASE WHEN blob_id % 2 = 0 THEN CAST(floor(size / 2) AS BIGINT) END AS compressed_size FROM blobs WHERE blob_id % 5 <> 0")
def _(spark, d):
    b = m.blobs(spark, d).withColumn("compressed_size", F.lit(None).cast("long"))
    sized = bl.set_compressed_size(b, b.where("blob_id % 2 = 0").select("blob_id", F.floor(F.col("size") / 2).alias("compressed_size")))
    return bl.delete_blobs(sized, b.where("blob_id % 5 = 0")).select("blob_id", "compressed_size")


@registered("dd04_recheck", BLOBS, VERSIONS, sql="SELECT blob_id FROM blobs WHERE blob_id NOT IN (SELECT blob_id FROM fv)")
def _(spark, d):
    v = m.versions(spark, d)
    listed = bl.unreferenced(m.blobs(spark, d), v.where("id % 3 = 0"), datetime(2100, 1, 1), limit=None)
    return bl.still_unreferenced(listed, v).select("blob_id")


# queue, worker and streams


@registered("st01_st06_stream", VERSIONS, sql="SELECT CAST(id AS VARCHAR) AS id, CAST(inode_id AS VARCHAR) AS inode_id, CAST(row_number() OVER (PARTITION BY inode_id ORDER BY id) AS INTEGER) AS version_number FROM fv")
def _(spark, d):
    rows = m.versions(spark, d).select(F.col("id").alias("seq"), F.col("inode_id").cast("string"), F.col("id").cast("string").alias("version_id"), "content_hash", "size")
    base = new_folder(spark, "queue")
    documents.write_markers(schema.conform(rows, "pending_markers"), f"{base}/in")
    log = queue.CommitLog(spark, f"{base}/log", rows.select(F.col("inode_id").alias("id")).distinct())
    queue.drain(log, queue.stream_markers(spark, f"{base}/in"), f"{base}/cp").awaitTermination()
    documents.write_markers(schema.conform(rows.where("seq % 2 = 0"), "pending_markers"), f"{base}/in")  # queued again: nothing is committed twice
    queue.drain(log, queue.stream_markers(spark, f"{base}/in"), f"{base}/cp").awaitTermination()
    return log.versions().select("id", "inode_id", "version_number")


@registered("st04_idempotent", VERSIONS, sql="SELECT id, CAST(row_number() OVER (PARTITION BY inode_id ORDER BY id) + count(*) FILTER (WHERE id % 2 = 1) OVER (PARTITION BY inode_id) - count(*) FILTER (WHERE id % 2 = 1) OVER (PARTITION BY inode_id ORDER BY id) AS INTEGER) AS version_number FROM fv QUALIFY id % 2 = 0")
def _(spark, d):
    """All versions are replayed, twice each, where every other one is committed: the rest is added once, after the last."""
    v = m.versions(spark, d)
    order = Window.partitionBy("inode_id").orderBy("id")
    known = v.where("id % 2 = 1").withColumn("version_number", F.row_number().over(order))
    incoming = v.select(F.col("id").alias("seq"), "id", "inode_id")
    return ve.commit(v.select(F.col("inode_id").alias("id")).distinct(), known, incoming.union(incoming))[0].select("id", "version_number")


@registered("st11_embed", sql="SELECT CAST(doc_id AS VARCHAR) AS id, 'm' AS model_id, 8 AS dim FROM documents WHERE doc_id % 3 > 0 UNION ALL SELECT 'b' || doc_id, 'code', 16 FROM documents WHERE doc_id % 10 = 0")
def _(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("doc_id").cast("string").alias("id"), F.lit("generic").alias("special_type"), F.col("text").alias("search_text"), F.lit(datetime(2024, 1, 1)).alias("created_at"))
    nodes = docs.where("doc_id % 10 = 0").select(F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").cast("string").alias("version_id"), F.col("text").alias("source"))
    known = docs.where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("m").alias("model_id"))
    return queue.embed_versions(v, nodes, known, fn.test_embedding, "m", 8, "code", 16).select("id", "model_id", F.size("embedding").alias("dim"))


@registered("st12_finish", VERSIONS, sql="SELECT id, CASE WHEN id % 4 = 1 THEN 'failed' WHEN id % 4 = 0 THEN 'clean' ELSE status END AS status, CASE WHEN id % 4 = 1 THEN 1 ELSE 0 END AS retry_count FROM fv")
def _(spark, d):
    v = m.versions(spark, d)
    return queue.finish_embed(v, v.where("id % 4 = 0").select("id"), v.where("id % 4 = 1").select("id")).select("id", "status", "retry_count")


@registered("st13_insert_absent", sql="SELECT vec_id AS id, 'm' AS model_id FROM embeddings WHERE vec_id % 3 > 0")
def _(spark, d):
    e = m.embeddings(spark, d).select("id", "model_id")
    return queue.missing_embeddings(e.union(e), e.where("id % 3 = 0"))


@registered("st15_search_text", sql="SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'from json' END AS search_text FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("doc_id").alias("id"), F.lit('{"a": "from json"}').alias("special_data"), F.lit(None).cast("string").alias("search_text"))
    data = docs.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.lit(b"\xff\xfe")).alias("data"))
    return queue.set_search_text(v, data).select("id", "search_text")


@registered("st09_revert_stuck", VERSIONS, sql="SELECT id, CASE WHEN status = 'processing' AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 600 SECOND THEN 'pending' ELSE status END AS status FROM fv")
def _(spark, d):
    return ve.revert_stuck(m.versions(spark, d), datetime(2024, 1, 20)).select("id", "status")


@registered("st17_write", sql="SELECT item_id AS id, CAST(row_number() OVER (PARTITION BY item_id % 7 ORDER BY item_id) AS INTEGER) AS version_number, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, min(item_id) OVER (PARTITION BY sha256(text)) AS blob_id, CASE WHEN item_id % 3 = 0 THEN 'syntax_error' ELSE 'generic' END AS special_type FROM benchmark")
def _(spark, d):
    """A write of every item: hashed, deduplicated, compressed, noted where its syntax is wrong, and committed in order."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text", F.when(F.col("item_id") % 3 == 0, "fn broken( {").otherwise("fn a() {}").alias("code"))
    told = bl.dedup_contents(items, "id", "text").select("id", F.col("canonical_id").alias("blob_id"))
    packed = bl.pack(items, "id", "text").where("compressed_size > 0").select("id", "content_hash", "size", "compressed_size")
    noted = items.select("id", code.syntax_problem("code", F.lit("rust")).alias("note"))
    kind = F.when(F.col("note").isNotNull(), "syntax_error").otherwise("generic")
    rows = packed.join(told, "id").join(noted, "id").select(F.col("id").alias("seq"), "id", (F.col("id") % 7).alias("inode_id"), "content_hash", "size", "blob_id", kind.alias("special_type"))
    none = spark.createDataFrame([], "id long, inode_id long, version_number int, content_hash string")
    new, _ = ve.commit(spark.range(7), none, rows)
    return new.select("id", "version_number", "content_hash", "size", "blob_id", "special_type")


@registered("cl01_stream", EMBEDDINGS, sql="SELECT plugin_type, count(*) AS offered, count(*) FILTER (WHERE CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 0) AS members, count(*) FILTER (WHERE CAST(substring(plugin_type, 2) AS INTEGER) % 2 = 1) AS waiting FROM emb GROUP BY plugin_type")
def _(spark, d):
    """Every vector arrives in a stream; those of calibrated types all become members, the others wait."""
    base, e = new_folder(spark, "consolidate"), m.embeddings(spark, d)
    e.repartition(3).write.parquet(f"{base}/in")
    log = consolidate.ConsolidationLog(spark, f"{base}/state", m.thresholds(spark, d))
    arriving = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    consolidate.consolidate_stream(log, arriving, f"{base}/cp").awaitTermination()
    kept = consolidate.ConsolidationLog(spark, f"{base}/state", m.thresholds(spark, d))  # as after a restart
    members = cluster.centroids_of(kept.state()).where("is_active").groupBy("plugin_type").agg(F.sum("member_count").alias("members"))
    waiting = kept.waiting(e.schema).groupBy("plugin_type").agg(F.count("*").alias("waiting"))
    found = members.join(waiting, "plugin_type", "full_outer").na.fill(0)
    return found.select("plugin_type", (F.col("members") + F.col("waiting")).alias("offered"), "members", "waiting")


# lexical graph and symbols


@registered("lx02_links", sql="SELECT n_name AS lexical_node_id, 't' || (n_nationkey % 5) AS centroid_id, CASE WHEN n_nationkey % 2 = 0 THEN 0.9 ELSE 0.5 END AS weight FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    link = lambda weight: n.select(F.col("n_name").alias("lexical_node_id"), F.concat(F.lit("t"), (F.col("n_nationkey") % 5).cast("string")).alias("centroid_id"), F.lit(weight).alias("weight"), "n_nationkey")
    lost = link(0.1).withColumn("centroid_id", F.lit("nowhere"))
    new = link(0.9).where("n_nationkey % 2 = 0").union(lost)
    return lexical.link_words(link(0.5), new, m.centroids(spark, d).select("id"))


@registered("lx03_null_pos", sql="SELECT lower(n_name) AS lemma, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "nation").select(F.lower("n_name").alias("lemma"), F.lit(None).cast("string").alias("pos"), F.lit("en").alias("language"), F.lit(None).cast("string").alias("external_ref"))
    once = lexical.import_nodes(rows.limit(0).withColumn("id", F.lit("")), rows, "en")
    return lexical.import_nodes(once, rows, "en").groupBy("lemma").agg(F.count("*").alias("n"))


def _registry(spark, d):
    """A registry that has every symbol, some at another line and some struck off."""
    files = _rust_files(spark, d)
    return files.select("id", F.lit("c").alias("crate_name"), F.lit("function").alias("kind"), F.lit("f").alias("name"), F.col("path").alias("last_known_file"), F.when(F.col("doc_id") % 4 == 0, 9).otherwise(3).alias("last_known_line"), F.lit("Does it.").alias("doc_summary"), (F.col("doc_id") % 10 == 1).alias("tombstoned"), F.lit(None).cast("string").alias("tombstoned_reason"))


@registered("dq14_symbol_issues", sql="SELECT 'MissingId' AS class, count(*) AS n FROM documents UNION ALL SELECT 'StaleCache', count(*) FROM documents WHERE doc_id % 4 = 0 AND doc_id % 10 <> 1 UNION ALL SELECT 'DeadLink', count(*) FROM documents WHERE doc_id % 10 = 1")
def _(spark, d):
    files = _rust_files(spark, d)
    links = symbols.scan_links(files.select("path", F.concat(F.lit("see symbol://"), F.col("id")).alias("text")))
    return symbols.issues(symbols.scan_symbols(files), _registry(spark, d), links).groupBy("class").agg(F.count("*").alias("n"))


@registered("dq15_resolve", sql="SELECT lower(lpad(hex(12), 8, '0')) || '-0000-0000-0000-000000000000' AS id, 3 AS line, 'Does it.' AS summary, FALSE AS tombstoned FROM documents WHERE doc_id = 12")
def _(spark, d):
    wanted = f"{12:08x}-0000-0000-0000-000000000000"
    return symbols.resolve(_registry(spark, d), symbols.scan_symbols(_rust_files(spark, d)), wanted).select("id", "line", "summary", "tombstoned")


@registered("dq16_registry", sql="SELECT source AS crate_name, 'f' || doc_id AS name, FALSE AS tombstoned FROM documents")
def _(spark, d):
    return symbols.generate_registry(symbols.scan_symbols(_rust_files(spark, d)), _registry(spark, d)).select("crate_name", "name", "tombstoned")


# parts of larger operators on their own


@registered("ag08_document_frequency", sql="SELECT term, count(DISTINCT p_brand) AS df FROM (SELECT p_brand, unnest(list_filter(regexp_split_to_array(lower(p_name), '[_\\-./: ]'), lambda t: t <> '')) AS term FROM part) GROUP BY term")
def _(spark, d):
    words = table(spark, d, "part").select("p_brand", F.explode(fn.tokenize_identifier(F.col("p_name"))).alias("term"))
    return words.groupBy("term").agg(F.countDistinct("p_brand").alias("df"))


@registered("ag09_term_frequency", sql="SELECT p_brand, term, count(*) AS n, count(*) FILTER (WHERE pos = 0) AS first FROM (SELECT p_brand, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM (SELECT p_brand, list_filter(regexp_split_to_array(lower(p_name), '[_\\-./: ]'), lambda t: t <> '') AS w FROM part)) GROUP BY ALL")
def _(spark, d):
    words = table(spark, d, "part").select("p_brand", F.posexplode(fn.tokenize_identifier(F.col("p_name"))).alias("pos", "term"))
    return words.groupBy("p_brand", "term").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("first"))


@registered("ag17_running_statistics", EMBEDDINGS, sql="SELECT plugin_type, max(n) AS n, round(sum(v), 2) AS m2 FROM (SELECT plugin_type, pos, count(*) AS n, var_pop(embedding[pos]) * count(*) AS v FROM emb, unnest(range(1, 65)) AS p(pos) GROUP BY plugin_type, pos) GROUP BY plugin_type")
def _(spark, d):
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("id")
        done = cluster.Cluster.of((np.array(v, dtype=np.float32) for v in rows["embedding"]), 64)
        return pd.DataFrame([(rows["plugin_type"].iloc[0], done.count, round(done.m2, 2))], columns=["plugin_type", "n", "m2"])

    return m.embeddings(spark, d).select("id", "plugin_type", "embedding").groupBy("plugin_type").applyInPandas(fold, "plugin_type string, n long, m2 double")


@registered("cl08_combine", EMBEDDINGS, sql="SELECT count(*) AS n, (SELECT round(sum(v), 4) FROM (SELECT pos, var_pop(embedding[pos]) * count(*) AS v FROM emb, unnest(range(1, 65)) AS p(pos) GROUP BY pos)) AS m2 FROM emb")
def _(spark, d):
    flat = m.embeddings(spark, d).select("plugin_type", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    per = flat.groupBy("plugin_type", "pos").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), (F.var_pop("x") * F.count("*")).alias("v"))
    parts = per.groupBy("plugin_type").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda p: p["mean"]).alias("mean"), F.sum("v").alias("m2"))
    return aggregates.merge_statistics(parts.withColumn("whole", F.lit(1)), ["whole"]).select("n", F.round("m2", 4).alias("m2"))


@registered("jo02_blocks_of_versions", sql="SELECT d.doc_id AS id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en'")
def _(spark, d):
    nodes = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("version_id"))
    v = table(spark, d, "labels").select(F.col("doc_id").alias("version_id"), "quality")
    return nodes.join(v, "version_id").select("id", "quality")


@registered("st07_rate_limit", VERSIONS, sql="SELECT count(*) AS n, count(DISTINCT content_hash) AS hashes FROM fv")
def _(spark, d):
    rows = m.versions(spark, d).select(F.col("id").alias("seq"), F.col("inode_id").cast("string"), F.col("id").cast("string").alias("version_id"), "content_hash", "size")
    base = new_folder(spark, "limited")
    documents.write_markers(schema.conform(rows, "pending_markers").repartition(3), f"{base}/in")
    slow = queue.stream_markers(spark, f"{base}/in", files_per_trigger=1)  # held back, none refused
    slow.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(slow.schema).parquet(f"{base}/out").agg(F.count("*").alias("n"), F.countDistinct("content_hash").alias("hashes"))


@registered("st16_recover_dry_run", VERSIONS, sql="SELECT count(*) AS found, count(*) FILTER (WHERE id % 2 = 0) AS committed, count(*) FILTER (WHERE id % 2 = 1) AS already_committed, CAST(0 AS BIGINT) AS failed FROM fv")
def _(spark, d):
    v = m.versions(spark, d)
    markers = v.select(F.col("id").alias("seq"), F.col("id").alias("version_id"), "inode_id", "content_hash", "size", F.lit(None).cast("string").alias("created_at"))
    return queue.replay(v.select(F.col("inode_id").alias("id")).distinct(), v.where("id % 2 = 1"), markers)[1]


@registered("sr16_find_by_hash", VERSIONS, sql="SELECT id FROM fv WHERE content_hash = sha256('c11') ORDER BY created_at DESC, id LIMIT 1")
def _(spark, d):
    import hashlib

    return scans.newest_by_hash(m.versions(spark, d), hashlib.sha256(b"c11").hexdigest()).select("id")


# The tools and their arguments.
_TOOLS = """('delete_file', 'path', 'string', TRUE), ('delete_file', 'confirmation_token', 'string', FALSE), ('describe_plugin_type', 'plugin_type', 'string', TRUE), ('diff_functions', 'path', 'string', TRUE), ('diff_functions', 'v1', 'integer', TRUE), ('diff_functions', 'v2', 'integer', TRUE), ('find_broken_files', '', '', FALSE), ('find_by_hash', 'content_hash', 'string', TRUE), ('get_actor_activity', 'actor_id', 'string', TRUE), ('get_actor_activity', 'since', 'string', FALSE), ('get_actor_activity', 'limit', 'integer', FALSE), ('get_file_content', 'path', 'string', TRUE), ('get_file_content', 'version', 'integer', FALSE), ('get_file_history', 'path', 'string', TRUE), ('list_plugin_types', '', '', FALSE), ('overwrite_file', 'path', 'string', TRUE), ('overwrite_file', 'content', 'string', TRUE), ('overwrite_file', 'confirmation_token', 'string', FALSE), ('query_by_metadata', 'filter', 'object', TRUE), ('search_by_concept', 'query', 'string', FALSE), ('search_by_concept', 'query_vector', 'array', FALSE), ('search_by_concept', 'plugin_type', 'string', FALSE), ('search_by_concept', 'model_id', 'string', FALSE), ('search_by_concept', 'limit', 'integer', FALSE), ('search_fulltext', 'query', 'string', TRUE), ('search_fulltext', 'plugin_type', 'string', FALSE), ('search_fulltext', 'limit', 'integer', FALSE), ('search_functions', 'query', 'string', FALSE), ('search_functions', 'query_vector', 'array', FALSE), ('search_functions', 'language', 'string', FALSE), ('search_functions', 'kind', 'string', FALSE), ('search_functions', 'limit', 'integer', FALSE), ('search_semantic', 'query', 'string', FALSE), ('search_semantic', 'query_vector', 'array', FALSE), ('search_semantic', 'model_id', 'string', FALSE), ('search_semantic', 'limit', 'integer', FALSE), ('search_semantic', 'type_filter', 'string', FALSE)"""


@registered("ud04_tools", sql=f"SELECT * FROM (VALUES {_TOOLS}) AS t(tool, argument, type, required)")
def _(spark, d):
    from palimpsest.tools import standard_tools

    rows = []
    for tool in standard_tools(spark, {}).listed():
        own = tool["inputSchema"]
        rows += [(tool["name"], name, kind["type"], name in own["required"]) for name, kind in own["properties"].items()] or [(tool["name"], "", "", False)]
    return spark.createDataFrame(rows, "tool string, argument string, type string, required boolean")


def _catalogue(spark, d):
    """Files under nations under regions, each with a version."""
    files = schema.conform(m.inodes(spark, d).select("id", "ino", "parent_id", "name", "is_dir"), "inode_registry")
    v = files.where("not is_dir").select(F.concat(F.lit("v"), "id").alias("id"), F.col("id").alias("inode_id"), F.lit(1).alias("version_number"), F.sha2("name", 256).alias("content_hash"))
    return {"inode_registry": files, "file_versions": schema.conform(v, "file_versions")}


@registered("st18_confirmed_delete", sql="SELECT CAST(n_nationkey AS BIGINT) AS nation, count(c_custkey) AS versions FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey <> 2 GROUP BY n_nationkey")
def _(spark, d):
    """A region is deleted by the tool, with a token; what is left of its nations' files and versions."""
    from palimpsest.tools import standard_tools

    t = _catalogue(spark, d)
    tools = standard_tools(spark, t)
    path = "/" + table(spark, d, "region").where("r_regionkey = 2").first().r_name
    asked = tools.call("delete_file", path=path)
    tools.call("delete_file", path=path, confirmation_token=asked["confirmation_token"])
    files, v = t["inode_registry"], t["file_versions"].select(F.col("inode_id").alias("id"), F.lit(1).alias("one"))
    nations = files.where("is_dir and id like 'n%'").select(F.col("id").alias("parent_id"), F.substring("id", 2, 20).try_cast("long").alias("nation"))
    own = files.where("not is_dir").select("id", "parent_id").join(v, "id", "left")
    return nations.join(own, "parent_id", "left").groupBy("nation").agg(F.count("one").alias("versions"))


@registered("st18_confirmed_overwrite", sql="SELECT c_custkey AS id, 1 AS version_number, sha256(c_name) AS content_hash, c_custkey <> 3 AS is_current FROM customer UNION ALL SELECT 3, 2, sha256('new words'), TRUE")
def _(spark, d):
    """A file is overwritten by the tool, with a token."""
    from palimpsest.tools import standard_tools

    t = _catalogue(spark, d)
    tools = standard_tools(spark, t, store=stores.LocalStore(tempfile.mkdtemp(prefix="palimpsest-store-")))
    path = tree.with_paths(t["inode_registry"]).where("id = 'c3'").first().path
    asked = tools.call("overwrite_file", path=path, content="new words")
    tools.call("overwrite_file", path=path, content="other words", confirmation_token=asked["confirmation_token"])
    v = ve.with_is_current(t["file_versions"])
    return v.select(F.substring("inode_id", 2, 20).cast("long").alias("id"), "version_number", "content_hash", "is_current")


