"""The tool surface: named query builders with their arguments, and confirmation of destructive ones."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import types as T


@dataclass(frozen=True)
class Argument:
    kind: str  # of JSON schema; "numbers" is an array of them
    about: str
    required: bool = False

    def schema(self) -> dict:
        kind = {"type": "array", "items": {"type": "number"}} if self.kind == "numbers" else {"type": self.kind}
        return kind | {"description": self.about}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    arguments: dict[str, Argument]
    build: Callable

    @property
    def required(self) -> list[str]:
        return [n for n, a in self.arguments.items() if a.required]

    def schema(self) -> dict:
        return {"name": self.name, "description": self.description, "inputSchema": {"type": "object", "properties": {n: a.schema() for n, a in self.arguments.items()}, "required": self.required}}


#: Python types that a JSON value of each kind may have.
_TYPES = {"string": str, "integer": int, "object": (dict, str), "numbers": (list, tuple)}


class Registry:
    """Tools by name. An argument a tool doesn't know or that is of another type, or one it lacks, is an error."""

    def __init__(self) -> None:
        self._tools: dict[str, Tool] = {}

    def add(self, name: str, description: str, build: Callable, **arguments: Argument) -> None:
        self._tools[name] = Tool(name, description, arguments, build)

    def listed(self) -> list[dict]:
        return [self._tools[n].schema() for n in sorted(self._tools)]

    def call(self, tool: str, **arguments):
        if tool not in self._tools:
            raise LookupError(f"unknown tool {tool}")
        known = self._tools[tool]
        lacking = [a for a in known.required if a not in arguments]
        strange = [a for a, v in arguments.items() if a not in known.arguments or (v is not None and not isinstance(v, _TYPES[known.arguments[a].kind]))]
        if lacking or strange:
            raise TypeError(f"{tool}: missing {lacking}, unknown or of another type {strange}")
        return known.build(**arguments)


@dataclass
class Confirmations:
    """One-time tokens for destructive calls, bound to the call and its path, good for five minutes."""

    seconds: float = 300.0
    clock: Callable[[], float] = time.monotonic
    _issued: dict[str, tuple[str, float, object]] = field(default_factory=dict)

    def _bound(self, action: str, path: str) -> str:
        return hashlib.sha256(f"{action}\0{path}".encode()).hexdigest()

    def issue(self, action: str, path: str, kept: object = None) -> str:
        """A token; ``kept`` is what the call was asked to do, given back when it is used."""
        now = self.clock()
        self._issued = {t: i for t, i in self._issued.items() if i[1] >= now}
        token = secrets.token_hex(16)
        self._issued[token] = (self._bound(action, path), now + self.seconds, kept)
        return token

    def use(self, token: str, action: str, path: str) -> object:
        bound, until, kept = self._issued.pop(token, (None, 0.0, None))
        if bound != self._bound(action, path) or self.clock() > until:
            raise PermissionError(f"no valid confirmation for {action} {path}")
        return kept


def standard_tools(spark, catalog: dict, embed=None, store=None, confirmations: Confirmations | None = None, now: Callable[[], datetime] = datetime.now) -> Registry:
    """The tools over a catalogue of tables by name (see ``schema``).

    The destructive ones ask for a confirmation first and, called again with its
    token, put the tables after the change into the catalogue. ``store`` takes the
    bytes of an overwritten file.
    """
    from palimpsest.operators import fulltext, scans, search, tree, versions
    from palimpsest.sources import documents, stores
    from palimpsest.streaming.queue import submit

    confirmations = confirmations or Confirmations()
    t, out = catalog, Registry()

    def resolved(path: str):
        return tree.must_resolve(t["inode_registry"], path)

    def semantic(query=None, query_vector=None, model_id=None, limit=10, type_filter="generic"):
        own = t["embeddings"] if model_id is None else t["embeddings"].where(t["embeddings"]["model_id"] == model_id)
        return search.search_semantic(t["concept_centroids"], t["centroid_members"], own, query, query_vector, embed, limit, type_filter)

    def functions(query=None, query_vector=None, language="rust", kind=None, limit=10):
        if query_vector is None:
            if query is None or embed is None:
                raise ValueError("a query or a query vector is needed")
            query_vector = embed(query)
        return search.search_functions(t["concept_centroids"], t["centroid_members"], t["embeddings"], t["ast_nodes"], query_vector, language, kind, limit)

    def concepts(query=None, query_vector=None, plugin_type=None, model_id=None, limit=10):
        if query is None and query_vector is None:
            own = t["concept_centroids"] if model_id is None else t["concept_centroids"].where(t["concept_centroids"]["model_id"] == model_id)
            return search.browse_concepts(own, t["consolidation_thresholds"], plugin_type or "generic", limit)
        return semantic(query, query_vector, model_id, limit, plugin_type or "generic")

    def content(path, version=None):
        return stores.file_content(scans.version_of(t["file_versions"], resolved(path).id, version), t["blob_bytes"])

    def diff(path, v1, v2):
        inode = resolved(path).id
        nodes = [t["ast_nodes"].join(scans.version_of(t["file_versions"], inode, n).selectExpr("id AS version_id"), "version_id") for n in (v1, v2)]
        return versions.diff_functions(*nodes)

    def asked(action, path, kept=None):
        return {"status": "confirmation_required", "confirmation_token": confirmations.issue(action, path, kept), "action": action, "path": path}

    def delete(path, confirmation_token=None):
        if confirmation_token is None:
            return asked("delete_file", path)
        confirmations.use(confirmation_token, "delete_file", path)
        gone = tree.descendants(t["inode_registry"], spark.createDataFrame([(resolved(path).id,)], t["inode_registry"].select("id").schema))
        hung = {name: (t[name], "version_id") for name in ("ast_nodes",) if name in t}
        t.update(tree.delete_cascade(t["inode_registry"], gone, t["file_versions"], hung))
        return {"status": "success", "action": "delete_file", "path": path, "version_id": None}

    def overwrite(path, content, confirmation_token=None):
        if confirmation_token is None:
            return asked("overwrite_file", path, content)
        content = confirmations.use(confirmation_token, "overwrite_file", path)  # what was confirmed is written
        inode = resolved(path)
        last = t["file_versions"].where(t["file_versions"]["inode_id"] == inode.id).agg({"version_number": "max"}).first()[0] or 0
        marker = submit(inode.id, last + 1, inode.name, content.encode(), store)
        wanted = t["file_versions"].schema
        row = spark.createDataFrame([(last + 1, *(now() if f.name == "created_at" else marker.get("version_id" if f.name == "id" else f.name) for f in wanted))], T.StructType([T.StructField("seq", T.LongType()), *(T.StructField(f.name, f.dataType) for f in wanted)]))
        new, _ = versions.commit(t["inode_registry"], t["file_versions"], row)
        t["file_versions"] = t["file_versions"].unionByName(new.select(*t["file_versions"].columns))
        t["inode_registry"] = versions.advance_inodes(t["inode_registry"], t["file_versions"].where(t["file_versions"]["inode_id"] == inode.id))
        return {"status": "success", "action": "overwrite_file", "path": path, "version_id": marker["version_id"]}

    files = lambda: tree.reachable_files(t["inode_registry"])
    text = lambda about, required=False: Argument("string", about, required)
    number = lambda about, required=False: Argument("integer", about, required)
    path, limit, vector = text("path of a file", True), number("rows at most"), Argument("numbers", "a vector to search by")
    query, token = text("text to search by"), text("token that the first call gave")
    out.add("search_semantic", "Versions near a text or vector", semantic, query=query, query_vector=vector, model_id=text("embedding model"), limit=limit, type_filter=text("plugin type"))
    out.add("search_functions", "Code blocks near a text or vector", functions, query=query, query_vector=vector, language=text("programming language"), kind=text("kind of block"), limit=limit)
    out.add("search_by_concept", "Concepts near a query, or the largest ones", concepts, query=query, query_vector=vector, plugin_type=text("plugin type"), model_id=text("embedding model"), limit=limit)
    out.add(
        "search_fulltext", "Versions and code blocks by their text", lambda query, plugin_type=None, limit=20: fulltext.search_fulltext(t["file_versions"], t["ast_nodes"], t["inode_registry"], query, plugin_type, limit),
        query=text("words to search for", True), plugin_type=text("plugin type"), limit=limit,
    )
    out.add("get_file_content", "A file's content, text or base64", content, path=path, version=number("version number; the latest without it"))
    out.add("get_file_history", "A file's versions", lambda path: scans.history(t["file_versions"], resolved(path).id), path=path)
    out.add("diff_functions", "Code blocks that differ between two versions", diff, path=path, v1=number("earlier version", True), v2=number("later version", True))
    out.add("find_by_hash", "The newest version of a hash", lambda content_hash: scans.newest_by_hash(t["file_versions"], content_hash), content_hash=text("SHA-256 in hex", True))
    out.add(
        "query_by_metadata", "Versions whose JSON holds a filter", lambda filter: scans.by_metadata(t["file_versions"], files(), json.loads(filter) if isinstance(filter, str) else filter),
        filter=Argument("object", "JSON that the metadata must hold", True),
    )
    out.add("find_broken_files", "Versions that failed their syntax check", lambda: scans.broken_files(t["file_versions"], files()))
    out.add(
        "get_actor_activity", "What an agent wrote", lambda actor_id, since=None, limit=None: scans.actor_activity(t["file_versions"], actor_id, since, limit),
        actor_id=text("agent", True), since=text("ISO 8601 time"), limit=limit,
    )
    out.add("list_plugin_types", "Plugin types", lambda: documents.list_plugin_types(spark, t.get("plugins_dir")))
    out.add("describe_plugin_type", "One plugin type", lambda plugin_type: documents.describe_plugin_type(spark, plugin_type, t.get("plugins_dir")), plugin_type=text("plugin type", True))
    out.add("delete_file", "Deletes a file and its versions, once confirmed", delete, path=path, confirmation_token=token)
    out.add("overwrite_file", "Writes a new version of a file, once confirmed", overwrite, path=path, content=text("the new content", True), confirmation_token=token)
    return out
