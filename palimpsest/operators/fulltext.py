"""Full-text search: BM25 ranks, and the plain substring search it falls back on.

BM25 is Okapi's with k1 = 1.2 and b = 0.75 over lower-cased runs of letters and
digits. Texts are tokenised once: the pass that writes the counts of those that
hold a term observes the corpus statistics of all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.session import new_folder, written

K1, B = 1.2, 0.75
NOT_WORD = r"[^\p{L}\p{N}]+"


def tokens(text):
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def bm25(docs: DataFrame, query: str, k: int = 20, id_col: str = "id", text_col: str = "search_text") -> DataFrame:
    """(id, score) of the k best documents for a query; documents without any of its terms have no score."""
    import re

    terms = sorted({t for t in re.split(r"[^\w]|_", query.lower()) if t})
    words = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("w"))
    asked = F.array(*(F.lit(t) for t in terms)) if terms else F.expr("cast(array() as array<string>)")
    counted = words.select("id", F.size("w").alias("dl"), F.transform(asked, lambda t: F.size(F.filter("w", lambda w: w == t))).alias("tf"))
    seen = Observation()
    totals = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    watched = counted.observe(seen, F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words"), *totals)
    spark = docs.sparkSession
    hits = written(watched.where(F.exists("tf", lambda c: c > 0)), new_folder(spark, "bm25"))
    corpus = seen.get
    mean = (corpus["words"] or 0) / max(1, corpus["n"])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (corpus["n"] - corpus[f"df{i}"] + 0.5) / (corpus[f"df{i}"] + 0.5))
        tf = F.col("tf")[i].cast("double")
        score = score + F.lit(idf) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    return hits.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def substring_search(versions: DataFrame, ast_nodes: DataFrame, inodes: DataFrame, query: str, limit: int = 20, plugin_type: str | None = None) -> DataFrame:
    """(kind, id, name, snippet, score): files by text, code blocks by source or name, all at score 1."""
    own = versions if plugin_type is None else versions.where(F.col("special_type") == plugin_type)
    named = inodes.select(F.col("id").alias("inode_id"), "name")
    files = own.where(fn.contains_ignoring_case(F.col("search_text"), query)).join(named, "inode_id").select(F.lit("file").alias("kind"), "id", "name", fn.snippet(F.col("search_text")).alias("snippet"))
    hit = fn.contains_ignoring_case(F.col("source"), query) | fn.contains_ignoring_case(F.col("name"), query)
    nodes = ast_nodes.where(hit).join(own.select(F.col("id").alias("version_id")), "version_id", "left_semi").select(F.col("kind"), "id", "name", fn.snippet(F.col("source")).alias("snippet"))
    both = files.orderBy("id").limit(limit).unionByName(nodes.orderBy("id").limit(limit))
    return both.withColumn("score", F.lit(1.0)).orderBy(F.desc("score"), "id", "kind").limit(limit)


def search_fulltext(versions: DataFrame, ast_nodes: DataFrame, inodes: DataFrame, query: str, plugin_type: str | None = None, limit: int = 20, ranked: bool = True) -> DataFrame:
    """(kind, id, name, snippet, score); files and code blocks are ranked as corpora of their own."""
    if not ranked:
        return substring_search(versions, ast_nodes, inodes, query, limit, plugin_type)
    own = versions if plugin_type is None else versions.where(F.col("special_type") == plugin_type)
    files = bm25(own, query, limit).join(own, "id").join(inodes.select(F.col("id").alias("inode_id"), "name"), "inode_id").select(F.lit("file").alias("kind"), "id", "name", fn.snippet(F.col("search_text")).alias("snippet"), "score")
    mine = ast_nodes.join(own.select(F.col("id").alias("version_id")), "version_id", "left_semi")
    texts = mine.withColumn("search_text", F.concat_ws(" ", "name", "source"))
    nodes = bm25(texts, query, limit).join(mine, "id").select("kind", "id", "name", fn.snippet(F.col("source")).alias("snippet"), "score")
    return files.unionByName(nodes).orderBy(F.desc("score"), "id", "kind").limit(limit)
