"""Scenarios that join several operators, on small tables."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest import schema, tools
from palimpsest.operators import blobs as bl, cluster, fulltext, lexical, quality, scans, search, symbols, tree, versions as ve
from palimpsest.sources import documents, stores
from palimpsest.streaming import queue

NOW = datetime(2024, 6, 1)


def markers(spark, rows):
    """(seq, inode, version, hash) as markers."""
    made = [(s, i, v, h, 10) for s, i, v, h in rows]
    return schema.conform(spark.createDataFrame(made, "seq long, inode_id string, version_id string, content_hash string, size long"), "pending_markers").withColumn("created_at", F.lit("2024-05-01T00:00:00Z"))


def versions(spark, rows):
    return schema.conform(spark.createDataFrame(rows, "id string, inode_id string, version_number int, content_hash string, parent_version_id string"), "file_versions")


def inodes(spark, rows):
    return schema.conform(spark.createDataFrame(rows, "id string, ino long, parent_id string, name string, is_dir boolean"), "inode_registry")


def test_commit_numbers_and_replay(spark):
    files = inodes(spark, [("f", 2, "root", "f", False)])
    none = spark.createDataFrame([], schema.schema_of("file_versions"))
    queued = markers(spark, [(2, "f", "v2", "h2"), (1, "f", "v1", "h1"), (3, "f", "v3", "h3"), (4, "lost", "v4", "h4")])
    new, report = queue.replay(files, none, queued)
    assert [(r.id, r.version_number, r.parent_version_id, r.content_hash) for r in new.orderBy("version_number").collect()] == [("v1", 1, None, "h1"), ("v2", 2, "v1", "h2"), ("v3", 3, "v2", "h3")]
    assert tuple(report.first()) == (4, 3, 0, 1)
    again, report = queue.replay(files, schema.conform(new, "file_versions"), queued)
    assert again.count() == 0 and tuple(report.first()) == (4, 0, 3, 1)


def test_overlay_and_withdraw(spark):
    done = versions(spark, [("v1", "f", 1, "h1", None), ("w1", "g", 1, "k1", None)])
    queued = markers(spark, [(5, "f", "v2", "h2"), (6, "f", "v3", "h3")])
    got = {r.inode_id: (r.content_hash, r.pending) for r in queue.overlay(done, queued).collect()}
    assert got == {"f": ("h3", True), "g": ("k1", False)}
    left = queue.withdraw(queued, spark.createDataFrame([("v2",)], "id string"))
    assert [r.version_id for r in left.collect()] == ["v3"]


def test_stream_commits_once(spark, tmp_path):
    files = inodes(spark, [("f", 2, "root", "f", False)])
    folder, log = str(tmp_path / "queue"), str(tmp_path / "log")
    documents.write_markers(markers(spark, [(1, "f", "v1", "h1"), (2, "f", "v2", "h2")]), folder)
    commits = queue.CommitLog(spark, log, files)
    queue.drain(commits, queue.stream_markers(spark, folder), str(tmp_path / "cp")).awaitTermination()
    documents.write_markers(markers(spark, [(2, "f", "v2", "h2"), (3, "f", "v3", "h3")]), folder)
    queue.drain(commits, queue.stream_markers(spark, folder), str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.version_number, r.id, r.parent_version_id) for r in commits.versions().collect())
    assert got == [(1, "v1", None), (2, "v2", "v1"), (3, "v3", "v2")]


def test_marker_files(spark, tmp_path):
    for name, seq in ((f"{9:020d}_{'b' * 64}.json", 1), (f"{3:020d}_{'a' * 64}.json", 2), ("x.json", 3)):
        (tmp_path / name).write_text(json.dumps({"seq": seq, "version_id": f"v{seq}"}))
    assert [(r.seq, r.version_id) for r in documents.read_markers(spark, str(tmp_path)).collect()] == [(3, "v2"), (9, "v1")]


def test_blob_sharing(spark):
    cols = "seq long, blob_id string, content_hash string, shared boolean"
    stored = spark.createDataFrame([("s", "h", True), ("p", "h", False)], "blob_id string, content_hash string, shared boolean")
    new = spark.createDataFrame([(1, "a", "h", True), (2, "b", "k", True), (3, "c", "k", True), (4, "d", "h", False)], cols)
    got = {r.blob_id: (r.canonical_id, r.inserted) for r in bl.insert_blobs(stored, new).collect()}
    assert got == {"a": ("s", False), "b": ("b", True), "c": ("b", False), "d": ("d", True)}
    assert [r.blob_id for r in scans.dedup_target(stored, "h").collect()] == ["s"]


def test_garbage(spark):
    old, young = NOW - timedelta(days=2), NOW
    b = spark.createDataFrame([("gone", "h1", 1, old), ("named", "h2", 1, old), ("fresh", "h3", 1, young), ("used", "h4", 1, old)], "blob_id string, content_hash string, size long, created_at timestamp")
    v = spark.createDataFrame([("used", "h4")], "blob_id string, content_hash string")
    free, report = bl.collect_garbage(b, v, spark.createDataFrame([("h2",)], "content_hash string"), NOW)
    assert [r.blob_id for r in free.collect()] == ["gone"] and tuple(report.first()) == (1, 1, 1)


def test_scrub(spark, tmp_path):
    import zstandard

    pack = zstandard.ZstdCompressor().compress
    store = stores.LocalStore(str(tmp_path))
    for name, data in (("intact", pack(b"hello")), ("mismatch", pack(b"goodbye")), ("undecodable", b"junk"), ("extra", pack(b"x"))):
        store.put(name, data)
    import hashlib

    wanted = hashlib.sha256(b"hello").hexdigest()
    expected = spark.createDataFrame([(n, wanted) for n in ("intact", "mismatch", "undecodable", "missing")], "blob_id string, content_hash string")
    states = bl.scrub(expected, store.frame(spark))
    assert {r.blob_id: r.state for r in states.collect()} == {"intact": "intact", "mismatch": "mismatch", "undecodable": "undecodable", "missing": "missing", "extra": "unreferenced"}
    assert tuple(bl.scrub_report(states).first()) == (3, 1, 1, 1, 1, 1)
    assert store.exists("undecodable") and store.get("intact") == pack(b"hello")
    store.delete("extra")
    assert not store.exists("extra")


def test_import_and_content(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, data in (("a.txt", b"same"), ("d/b.txt", b"same"), ("c.bin", b"\xff\x00")):
        (tmp_path / name).write_bytes(data)
    files = stores.read_directory(spark, str(tmp_path))
    assert stores.import_indexed(files).where("external_path is not null and blob_id is null").count() == 3
    copied = stores.import_copied(files)
    rows = copied.collect()
    assert sum(r.inserted for r in rows) == 2 and sum(r.stored is not None for r in rows) == 2
    bytes_ = copied.where("inserted").select("blob_id", F.col("stored").alias("data"))
    got = {r.id: (r.text, r.bytes_base64) for r in stores.file_content(copied.select("id", "blob_id"), bytes_).collect()}
    assert sorted(got.values(), key=str) == sorted([("same", None), ("same", None), (None, "/wA=")], key=str)


def test_trees_deep_and_with_cycles(spark):
    rows = [("n0", 1, None, "", True)] + [(f"n{k}", k + 1, f"n{k - 1}", f"d{k}", True) for k in range(1, 501)]
    rows += [("x", 900, "z", "x", True), ("y", 901, "x", "y", True), ("z", 902, "y", "z", True), ("w", 903, "z", "w", False), ("lost", 904, "nowhere", "l", False)]
    t = inodes(spark, rows)
    found = {r.id: r for r in tree.with_paths(t).collect()}
    assert set(found) == {f"n{k}" for k in range(501)}
    assert found["n500"].depth == 500 and found["n500"].path == "".join(f"/d{k}" for k in range(1, 501)) and found["n0"].path == "/"
    below = lambda root: {r.id for r in tree.descendants(t, t.where(F.col("id") == root)).collect()}
    assert below("n250") == {f"n{k}" for k in range(250, 501)} and below("y") == {"x", "y", "z", "w"} and below("lost") == {"lost"} and below("none") == set()
    assert tree.with_paths(t.limit(0)).count() == 0


def test_tree(spark):
    t = inodes(spark, [("root", 1, None, "", True), ("a", 2, "root", "a", True), ("f", 3, "a", "f.rs", False), ("g", 4, "root", "g", False), ("o", 5, None, "orphan", False)])
    assert {r.id: r.path for r in tree.with_paths(t).collect()} == {"root": "/", "a": "/a", "f": "/a/f.rs", "g": "/g"}
    assert tree.must_resolve(t, " a//f.rs/ ").id == "f" and tree.must_resolve(t, "/").id == "root"
    with pytest.raises(FileNotFoundError):
        tree.must_resolve(t, "/a/x")
    moved, replaced = tree.rename(t, "f", "root", "g")
    assert [r.id for r in replaced.collect()] == ["g"] and tree.must_resolve(moved, "/g").id == "f"
    assert {r.id for r in tree.descendants(t, t.where("id = 'a'")).collect()} == {"a", "f"}
    v = versions(spark, [("v1", "f", 1, "h", None), ("v2", "g", 1, "h", None)])
    out = tree.delete_cascade(t, t.where("id = 'f'"), v, {"ast_nodes": (spark.createDataFrame([("n", "v1"), ("m", "v2")], "id string, version_id string"), "version_id")})
    assert [r.id for r in out["ast_nodes"].collect()] == ["m"] and out["file_versions"].count() == 1
    changed = tree.set_attributes(t, "f", mode=0o600, uid=7).where("id = 'f'").first()
    assert (changed["mode"] & 0o7777, changed["mode"] & 0o170000, changed["uid"]) == (0o600, 33188 & 0o170000, 7)


def test_diff(spark):
    cols = "kind string, name string, start_line int, end_line int, source string, content_hash string"
    old = spark.createDataFrame([("function", "a", 1, 2, "x", "1"), ("function", "b", 3, 4, "y", "2"), ("function", "c", 5, 6, "z", "3"), ("function", "c", 9, 9, "w", "4")], cols)
    new = spark.createDataFrame([("function", "a", 1, 2, "x", "1"), ("function", "c", 7, 8, "w", "4"), ("function", "d", 9, 9, "v", "5"), ("struct", "b", 3, 4, "y2", "6")], cols)
    assert {(r.change, r.kind, r.name) for r in ve.diff_functions(old, new).collect()} == {("removed", "function", "b"), ("added", "function", "d"), ("added", "struct", "b")}


def test_merge_hits(spark):
    one = spark.createDataFrame([("id1", 0.25), ("id2", 0.50)], "id string, distance double")
    two = spark.createDataFrame([("id2", 0.10), ("id3", 0.80)], "id string, distance double")
    assert [tuple(r) for r in search.merge_hits(one, two, 2).collect()] == [("id2", 0.10, "buffered"), ("id1", 0.25, "crystallised")]


def vectors(spark, rows):
    made = [(i, "m", 4, "t", v, False, True, NOW + timedelta(seconds=k)) for k, (i, v) in enumerate(rows)]
    return spark.createDataFrame(made, schema.schema_of("embeddings"))


def limits(spark, **kw):
    base = {"plugin_type": "t", "model_id": "m", "join_threshold": 0.5, "split_variance_threshold": 1.0, "max_members_per_centroid": 100, "batch_size": 200} | kw
    return schema.conform(spark.createDataFrame([base]), "consolidation_thresholds")


def test_consolidation_cycle(spark):
    e = vectors(spark, [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.99, 0.05, 0.0, 0.0]), ("c", [0.0, 0.0, 0.0, 1.0])])
    t = limits(spark, join_threshold=0.4, batch_size=2)
    first = cluster.consolidate_batch(e, t, cluster.empty_state(spark)).cache()
    assert {r.member_id for r in cluster.members_of(first).collect()} == {"a", "b"}
    left = cluster.buffered_after(e, first)
    second = cluster.consolidate_batch(left, t, first).cache()
    assert cluster.buffered_after(e, second).where("not consolidated").count() == 0
    assert sorted(r.member_count for r in cluster.centroids_of(second).where("is_active").collect()) == [1, 2]
    cen = cluster.centroids_of(second).withColumn("dim", F.lit(4))
    hit = search.search_by_concept(cen, cluster.members_of(second), cluster.buffered_after(e, second), [1.0, 0.0, 0.0, 0.0], 1).first()
    assert hit.id == "a" and hit.distance < 1e-4 and hit.source == "crystallised"
    repeat = cluster.consolidate_batch(e, t, cluster.empty_state(spark))
    assert sorted(map(str, repeat.collect())) == sorted(map(str, first.collect()))


def test_split_and_merge_delete_nothing(spark):
    e = vectors(spark, [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0, 0.0]), ("c", [0.0, 0.0, 1.0, 0.0])])
    state = cluster.consolidate_batch(e, limits(spark, join_threshold=1.5, split_variance_threshold=0.01, max_members_per_centroid=2), cluster.empty_state(spark)).cache()
    cen = cluster.centroids_of(state)
    assert cen.where("not is_active").count() >= 1 and cen.where("is_active").agg(F.sum("member_count")).first()[0] == 3
    merged = cluster.centroids_of(cluster.merge_centroids(state, 2.0)).cache()
    assert merged.where("merged_into is not null").count() >= 2 and merged.count() > cen.count()
    assert merged.where("is_active").agg(F.sum("member_count")).first()[0] == 3


def test_calibration(spark):
    empty = schema.conform(spark.createDataFrame([], "plugin_type string"), "consolidation_thresholds")
    with pytest.raises(scans.MissingCalibration):
        scans.thresholds_of(empty, "t", "m")
    assert scans.thresholds_of(cluster.set_threshold(empty, "t", "m", 0.42), "t", "m").join_threshold == 0.42
    assert cluster.should_run(500, 0) and cluster.should_run(0, 86400) and cluster.should_run(1, 1800) and not cluster.should_run(0, 1800)
    assert cluster.merge_due(20) and not cluster.merge_due(21) and not cluster.merge_due(0)


def test_fulltext(spark):
    text = "an intelligent semantic store, rust database"
    v = schema.conform(spark.createDataFrame([("v1", "f", text), ("v2", "f", "nothing here")], "id string, inode_id string, search_text string"), "file_versions")
    n = schema.conform(spark.createDataFrame([("n1", "v1", "function", "hello_world", "fn hello_world() {}")], "id string, version_id string, kind string, name string, source string"), "ast_nodes")
    i = inodes(spark, [("f", 2, None, "f.rs", False)])
    assert [r.id for r in fulltext.search_fulltext(v, n, i, "INTELLIGENT", ranked=False).collect()] == ["v1"]
    assert fulltext.search_fulltext(v, n, i, "hello_world", ranked=False).first().id == "n1"
    best = fulltext.search_fulltext(v, n, i, "intelligent database").first()
    assert best.id == "v1" and best.score > 0


def test_wordnet(spark, tmp_path):
    doc = {"language": "pl", "nodes": [{"lemma": "funkcja", "pos": "n"}, {"lemma": "metoda", "pos": "n", "external_ref": "x"}], "edges": [{"from": "metoda", "to": "funkcja", "relation": "Hypernym"}, {"from": "metoda", "to": "nowhere", "relation": "synonym"}]}
    (tmp_path / "w.json").write_text(json.dumps(doc))
    nodes, edges = documents.read_wordnet(spark, str(tmp_path / "w.json"))
    none = spark.createDataFrame([], schema.schema_of("lexical_nodes"))
    once = lexical.import_nodes(none, nodes, "en")
    twice = lexical.import_nodes(once, nodes, "en")
    assert once.count() == 2 and sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    empty = spark.createDataFrame([], schema.schema_of("lexical_edges"))
    assert lexical.import_edges(once, empty, edges, nodes, "pl").count() == 1
    with pytest.raises(Exception, match="unknown relation"):
        lexical.import_edges(once, empty, edges.withColumn("relation", F.lit("sister")), nodes, "pl").collect()


def test_quality_rules_fire_alone(spark):
    h = "0" * 64
    good = versions(spark, [("v1", "f", 1, h, None), ("v2", "f", 2, h, "v1")]).withColumns({"size": F.lit(1).cast("long"), "created_at": F.lit(NOW), "blob_id": F.lit("b")})
    files = inodes(spark, [("f", 2, None, "f", False)]).withColumn("current_blob_id", F.lit("b"))
    b = spark.createDataFrame([("b", h, 1)], "blob_id string, content_hash string, size long")
    assert quality.all_rules(files, good, b, NOW).count() == 0
    cases = {
        "I1.hash_format": (files, good.withColumn("content_hash", F.when(F.col("id") == "v2", "zz").otherwise(F.col("content_hash"))), b),
        "I1.blob_size_mismatch": (files, good, b.withColumn("size", F.lit(2).cast("long"))),
        "I2.broken_version_chain": (files, good.withColumn("parent_version_id", F.lit(None).cast("string")), b),
        "I3.current_blob_desync": (files.withColumn("current_blob_id", F.lit("other")), good, b),
    }
    for rule, (i, v, bb) in cases.items():
        assert rule in {r.rule for r in quality.all_rules(i, v, bb, NOW).collect()}, rule


def test_symbols_registry(spark):
    ids = [f"{k}1111111-2222-3333-4444-555555555555" for k in range(4)]
    files = spark.createDataFrame([("crates/a/src/x.rs", f"/// @id: {ids[0]}\npub fn one() {{}}\npub fn none() {{}}\n"), ("crates/b/src/y.rs", f"/// @id: {ids[1]}\npub fn two() {{}}\n/// @id: {ids[1]}\npub fn three() {{}}\n")], "path string, source string")
    found = symbols.scan_symbols(files)
    registry = schema.conform(spark.createDataFrame([(ids[0], "crates/a/src/x.rs", 9, False, None), (ids[2], "gone.rs", 1, True, "was here")], "id string, last_known_file string, last_known_line int, tombstoned boolean, doc_summary string"), "symbols")
    links = symbols.scan_links(spark.createDataFrame([("d.md", f"symbol://{ids[0]} symbol://{ids[2]} symbol://{ids[3]}")], "path string, text string"))
    assert [r["class"] for r in symbols.issues(found, registry, links).collect()] == ["MissingId", "DuplicateId", "StaleCache", "DeadLink", "DeadLink"]
    assert symbols.resolve(registry, found, ids[2]).first().summary == "was here"
    assert symbols.resolve(registry, found, ids[0]).first().line == 2
    made = symbols.generate_registry(found, registry)
    assert {(r.id, r.tombstoned) for r in made.collect()} == {(ids[0], False), (ids[1], False), (ids[2], True)}


def test_upsert_takes_nulls_as_equal(spark):
    base = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, p string, v int")
    new = spark.createDataFrame([("a", None, 9)], "k string, p string, v int")
    assert sorted((r.k, r.v) for r in scans.upsert(base, new, ["k", "p"]).collect()) == [("a", 9), ("b", 2)]


def test_tools(spark, tmp_path):
    t = {"inode_registry": inodes(spark, [("root", 1, None, "", True), ("f", 2, "root", "f", False)]), "file_versions": versions(spark, [("v1", "f", 1, "h", None)])}
    t["embeddings"] = vectors(spark, [("v1", [1.0, 0.0, 0.0, 0.0])])
    t["concept_centroids"] = schema.conform(spark.createDataFrame([], "id string"), "concept_centroids")
    t["centroid_members"] = schema.conform(spark.createDataFrame([], "centroid_id string"), "centroid_members")
    out = tools.standard_tools(spark, t)
    assert len(out.listed()) == 15
    assert [r.id for r in out.call("get_file_history", path="/f").collect()] == ["v1"]
    assert out.call("search_semantic", query_vector=[1.0, 0.0, 0.0, 0.0], type_filter="t").first().id == "v1"
    with pytest.raises(ValueError):
        out.call("search_semantic")
    with pytest.raises(TypeError):
        out.call("get_file_history", nothing=1)
    with pytest.raises(LookupError):
        out.call("describe_plugin_type", plugin_type="unknown")
    clock = [0.0]
    keys = tools.Confirmations(clock=lambda: clock[0])
    token = keys.issue("delete", "/f")
    with pytest.raises(PermissionError):
        keys.use(token, "delete", "/g")
    token = keys.issue("delete", "/f")
    keys.use(token, "delete", "/f")
    with pytest.raises(PermissionError):
        keys.use(token, "delete", "/f")
    token = keys.issue("delete", "/f")
    clock[0] = 301.0
    with pytest.raises(PermissionError):
        keys.use(token, "delete", "/f")


def test_schema_check(spark):
    assert schema.check_schema({}) == [f"missing table {t}" for t in schema.CORE_TABLES]
    full = {t: spark.createDataFrame([], schema.schema_of(t)) for t in schema.CORE_TABLES}
    assert schema.check_schema(full) == []
    assert schema.check_schema(full | {"blobs": full["blobs"].withColumn("refcount", F.lit(1))}) == ["forbidden column blobs.refcount"]


def test_network_store(spark):
    """Against a small server that keeps blobs in memory and speaks the store's interface."""
    import hashlib
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    from palimpsest.sources.ipfs import IpfsStore

    kept = {}

    class Handler(BaseHTTPRequestHandler):
        def answer(self, code, body=b""):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"] or 0))
            if "/add?" in self.path and "pin" not in self.path:
                data = body.split(b"\r\n\r\n", 1)[1].rsplit(b"\r\n--", 1)[0]
                cid = "b" + hashlib.sha256(data).hexdigest()
                kept[cid] = data
                return self.answer(200, json.dumps({"Hash": cid}).encode())
            if "pin/rm" in self.path:
                kept.pop(self.path.rpartition("=")[2], None)
            return self.answer(200, b"{}")

        def do_GET(self):
            cid = self.path.rpartition("/")[2]
            return self.answer(200, kept[cid]) if cid in kept else self.answer(404)

        do_HEAD = do_GET

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    store = IpfsStore(url, url)
    cid = store.put(b"some bytes")
    assert store.exists(cid) and store.get(cid) == b"some bytes"
    assert [bytes(r.data) for r in store.frame(spark.createDataFrame([(cid,)], "cid string")).collect()] == [b"some bytes"]
    store.delete(cid)
    assert not store.exists(cid)
    server.shutdown()


def test_lifecycle(spark):
    t = inodes(spark, [("root", 1, None, "", True), ("f", 2, "root", "f", False)])
    made = tree.create_inode(t, "root", "g", "g", uid=5)
    assert tuple(made.where("id = 'g'").select("ino", "uid", "is_dir").first()) == (3, 5, False)
    with pytest.raises(FileExistsError):
        tree.create_inode(t, "root", "f", "x")
    note = queue.submit("f", 1, "f.rs", b"fn a( {", _MemoryStore(), status_note="Unclosed")
    assert note["special_type"] == "syntax_error" and json.loads(note["special_data"]) == {"error": "Unclosed"}
    assert queue.embed_due(1, None, 0.6) and queue.embed_due(1001, 0, 0) and queue.embed_due(1, 61, 0) and not queue.embed_due(1, 1, 0.1) and not queue.embed_due(0, None, 9)


class _MemoryStore(dict):
    def exists(self, name):
        return name in self

    def put(self, name, data):
        self[name] = data


def test_gate_holds_back_and_refuses(spark, tmp_path):
    import threading

    gate = queue.Gate(most=2, patience=0.2)
    some = markers(spark, [(1, "f", "v1", "h1"), (2, "f", "v2", "h2")])
    assert queue.enqueue(gate, str(tmp_path / "q"), some) == 2 and gate.depth == 2
    with pytest.raises(queue.PendingQueueFull):
        queue.enqueue(gate, str(tmp_path / "q"), some.limit(1))
    assert gate.depth == 2 and spark.read.json(str(tmp_path / "q")).count() == 2  # nothing of it was made durable
    waiting = queue.Gate(most=1, patience=5.0)
    waiting.admit()
    threading.Timer(0.1, waiting.release).start()
    waiting.admit()
    with pytest.raises(Exception):
        queue.enqueue(queue.Gate(), "nowhere://x", some)


def test_embedding_worker(spark):
    clock = [100.0]
    v = schema.conform(spark.createDataFrame([(f"v{k}", "f", "pending") for k in range(3)] + [("w", "f", "clean")], "id string, inode_id string, status string"), "file_versions")
    v = v.withColumn("created_at", F.lit(NOW))
    worker = queue.EmbedWorker(lambda taken: (taken.where("id <> 'v1'").select("id"), taken.where("id = 'v1'").select("id")), clock=lambda: clock[0])
    told = lambda df: {r.id: r.status for r in df.collect()}
    worker.written()
    assert told(worker.step(v, NOW + timedelta(seconds=1))) == told(v)  # writes go on
    assert sorted(told(worker.step(v, NOW + timedelta(seconds=61))).values()) == ["clean", "clean", "pending", "pending"]  # forced: the first alone
    clock[0] += 1
    assert told(worker.step(v, NOW + timedelta(seconds=1))) == {"v0": "clean", "v1": "failed", "v2": "clean", "w": "clean"}


def test_consolidation_log_restarts_and_drops_nothing(spark, tmp_path):
    from palimpsest.streaming.consolidate import ConsolidationLog

    e = vectors(spark, [(f"a{k}", [1.0, k / 100, 0.0, 0.0]) for k in range(9)])
    other = vectors(spark, [("z", [0.0, 1.0, 0.0, 0.0])]).withColumn("plugin_type", F.lit("uncalibrated"))
    open_log = lambda: ConsolidationLog(spark, str(tmp_path / "log"), limits(spark, batch_size=2))
    assert open_log().state().count() == 0 and open_log().waiting(e.schema).count() == 0
    open_log().fold_batch(e.where("id < 'a5'").union(other), 0)
    open_log().fold_batch(e, 1)  # some are offered again
    open_log().fold_batch(e, 1)  # and the batch runs again
    log = open_log()
    assert sorted(r.member_id for r in cluster.members_of(log.state()).collect()) == [f"a{k}" for k in range(9)]
    assert [r.id for r in log.waiting(e.schema).collect()] == ["z"] and cluster.centroids_of(log.state()).where("is_active").agg(F.sum("member_count")).first()[0] == 9


def test_supervisor_merges_after_twenty_cycles(spark):
    from palimpsest.streaming.consolidate import Supervisor

    now = [0.0]
    e = vectors(spark, [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 0.05, 0.0, 0.0])])
    t = limits(spark, join_threshold=0.0001, batch_size=5, backlog_threshold=1)
    watch = Supervisor(lambda: t.withColumn("join_threshold", F.lit(0.0001)), lambda: now[0])
    state, ran = watch.cycle(e, cluster.empty_state(spark))
    assert ran == [("t", "m")] and cluster.centroids_of(state).where("is_active").count() == 2
    assert watch.cycle(cluster.buffered_after(e, state), state)[1] == []
    watch.cycles[("t", "m")] = 19
    far = Supervisor(lambda: t.withColumn("join_threshold", F.lit(0.004)), lambda: now[0])
    far.cycles[("t", "m")] = 19
    more = vectors(spark, [("c", [0.0, 0.0, 1.0, 0.0])])
    state, _ = far.cycle(more, state)
    assert cluster.centroids_of(state).where("merged_into is not null").count() == 2 and cluster.centroids_of(state).where("is_active").agg(F.sum("member_count")).first()[0] == 3


def test_vectors_of_other_lengths_are_an_error(spark):
    e = vectors(spark, [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 0.0])])
    with pytest.raises(Exception, match="2 dimensions among centroids of 4"):
        cluster.consolidate_batch(e, limits(spark), cluster.empty_state(spark)).collect()


def test_pairs_in_blocks_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 6))
    v[7] = v[3]
    rows = [(f"c{k:02d}", "t", "m", 6, x.tolist(), True) for k, x in enumerate(v)]
    cen = spark.createDataFrame(rows, "id string, plugin_type string, model_id string, dim int, centroid array<double>, is_active boolean")
    gap = search.cosine_distances(v, v)
    all_pairs = sorted((gap[i, j], f"c{i:02d}", f"c{j:02d}") for i in range(90) for j in range(i + 1, 90) if gap[i, j] < 0.7)
    got = [(r.a, r.b) for r in search.mergeable_pairs(cen, 0.7, 50, block=16).collect()]
    assert got == [(a, b) for _, a, b in all_pairs[:50]]
    e = cen.select("id", "plugin_type", "model_id", F.col("centroid").alias("embedding"))
    near = {r.id: r.distance for r in search.nearest_distances(e, block=16).collect()}
    np.fill_diagonal(gap, 9.0)
    assert all(abs(near[f"c{k:02d}"] - gap[k].min()) < 1e-12 for k in range(90))


def test_plugin_dictionaries_are_whole(spark):
    rust = documents.describe_plugin_type(spark, "rust")
    assert rust["match_extensions"] == [".rs"] and rust["embedding"]["dimensions"] == 1536 and rust["schema"]["has_unsafe"]["type"] == "boolean"
    rows = {r.type: r for r in documents.list_plugin_types(spark).collect()}
    assert json.loads(rows["png"].schema)["width"]["type"] == "integer" and rows["generic"].embedding is None and not rows["png"].ast
