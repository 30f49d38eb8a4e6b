"""JSON sources: pending markers, word nets, plugin dictionaries, symbol registries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.schema import schema_of

WORDNET = "language string, nodes array<struct<lemma:string,pos:string,external_ref:string>>, edges array<struct<`from`:string,`to`:string,relation:string>>"

# The plugin types that are always there.
BUILT_IN = {
    "rust": {
        "type": "rust",
        "description": "Rust source code file containing compiled, memory-safe system-level code.",
        "match_extensions": [".rs"],
        "schema": {
            "language": {"type": "string", "description": "Programming language identifier as detected by tree-sitter."},
            "node_count": {"type": "integer", "description": "Total number of top-level AST nodes extracted from this file."},
            "has_syntax_errors": {"type": "boolean", "description": "Whether tree-sitter detected any syntax errors during parsing."},
            "has_unsafe": {"type": "boolean", "description": "Whether this file contains any unsafe blocks."},
        },
        "ast": True,
        "embedding": {"model": "text-embedding-3-large", "dimensions": 1536, "description": "Semantic embedding of full source code, optimised for code similarity search."},
    },
    "png": {
        "type": "png",
        "description": "PNG image file containing raster graphics data with optional metadata.",
        "match_extensions": [".png"],
        "schema": {
            "width": {"type": "integer", "description": "Image width in pixels."},
            "height": {"type": "integer", "description": "Image height in pixels."},
            "color_type": {"type": "string", "description": "Colour mode, e.g. RGBA, RGB, Greyscale."},
            "has_alpha": {"type": "boolean", "description": "Whether image contains a transparency channel."},
            "text_metadata": {"type": "object", "description": "Key-value pairs from PNG tEXt chunks, e.g. Software, Author."},
        },
        "ast": False,
        "embedding": None,
    },
    "generic": {"type": "generic", "description": "Generic untyped file processed with default file-level embeddings.", "match_extensions": [], "schema": {}, "ast": False, "embedding": None},
}


def read_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Queued markers in order of their sequence; files with malformed names are passed over, bad bodies raise."""
    named = spark.read.schema(schema_of("pending_markers")).option("mode", "FAILFAST").option("multiLine", True).json(folder).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    seq, _ = fn.parse_marker_name(F.col("_file"))
    return named.withColumn("_seq", seq).where("_seq is not null").withColumn("seq", F.col("_seq")).drop("_seq", "_file").orderBy("seq")


def write_markers(markers: DataFrame, folder: str) -> None:
    """Append markers as JSON; the committer makes them visible at once."""
    markers.write.mode("append").json(folder)


def read_wordnet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes with language, edges) of documents {language, nodes[], edges[]}."""
    docs = spark.read.schema(WORDNET).option("multiLine", True).json(path)
    nodes = docs.select("language", F.explode("nodes").alias("n")).select("n.lemma", "n.pos", "language", "n.external_ref")
    edges = docs.select("language", F.explode("edges").alias("e")).select("e.from", "e.to", "e.relation")
    return nodes, edges


PLUGIN = "type string, description string, match_extensions array<string>, schema string, ast boolean, embedding string"


def list_plugin_types(spark: SparkSession, folder: str | None = None) -> DataFrame:
    """Plugin types by name; of a built-in name the built-in stands."""
    own = spark.createDataFrame([(p["type"], p["description"], p["match_extensions"], json.dumps(p["schema"]), p["ast"], json.dumps(p["embedding"]) if p["embedding"] else None) for p in BUILT_IN.values()], PLUGIN)
    if folder is None:
        return own.orderBy("type")
    found = spark.read.schema(PLUGIN).option("multiLine", True).json(folder)
    return own.unionByName(found.join(own.select("type"), "type", "left_anti").select(*own.columns)).orderBy("type")


def describe_plugin_type(spark: SparkSession, name: str, folder: str | None = None) -> dict:
    """The dictionary of a plugin type; here a file goes before a built-in."""
    if folder is not None:
        row = spark.read.schema(PLUGIN).option("multiLine", True).json(folder).where(F.col("type") == name).first()
        if row is not None:
            return row.asDict(recursive=True)
    if name not in BUILT_IN:
        raise LookupError(f"unknown plugin type {name}")
    return json.loads(json.dumps(BUILT_IN[name]))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    symbols = schema_of("symbols").simpleString().removeprefix("struct<").removesuffix(">")
    docs = spark.read.schema(f"generated_at string, generator_version string, symbols array<struct<{symbols}>>").option("multiLine", True).json(path)
    return docs.select(F.explode("symbols").alias("s")).select("s.*")


def read_source_tree(spark: SparkSession, root: str, extension: str = "rs") -> DataFrame:
    """(path, source) of the files of a source tree, tests and build output left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").text(root)
    named = files.select(F.input_file_name().alias("path"), F.col("value").alias("source"))
    return named.where(~F.col("path").rlike("/(target|tests)/"))
