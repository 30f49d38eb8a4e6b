"""The lexical graph, and labels of centroids by their members' names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import tokenize_identifier
from palimpsest.schema import LEXICAL_RELATIONS

_KEY = ["lemma", "pos", "language"]


def node_id(lemma, pos, language):
    """An id from the natural key; a null part of speech is a value like any other."""
    return F.sha2(F.concat_ws("|", language, F.coalesce(pos, F.lit("\u0000")), lemma), 256)


def import_nodes(existing: DataFrame, incoming: DataFrame, language: str) -> DataFrame:
    """existing nodes and those of a document; a repeated node keeps its reference unless a new one is given."""
    named = incoming.withColumn("language", F.when(F.coalesce(F.col("language"), F.lit("")) != "", F.col("language")).otherwise(F.lit(language)))
    new = named.select(node_id(F.col("lemma"), F.col("pos"), F.col("language")).alias("id"), *_KEY, "external_ref", F.lit(1).alias("_age"))
    both = existing.select("id", *_KEY, "external_ref", F.lit(0).alias("_age")).unionByName(new)
    return both.groupBy(*_KEY).agg(F.min_by("id", F.struct("_age", "id")).alias("id"), F.max_by("external_ref", F.when(F.col("external_ref").isNotNull(), F.struct("_age", "external_ref"))).alias("external_ref")).select("id", *_KEY, "external_ref")


def import_edges(nodes: DataFrame, existing: DataFrame, incoming: DataFrame, in_file: DataFrame, language: str) -> DataFrame:
    """existing edges and those of a document (from, to, relation), ends resolved by lemma.

    A lemma of the same document goes before one stored earlier in that language;
    an edge with an end that is nowhere is passed over, a relation that is not
    known is an error, and repeated edges count once.
    """
    wanted = F.lower(F.col("relation"))
    checked = incoming.select("from", "to", F.when(wanted.isin(*LEXICAL_RELATIONS), wanted).otherwise(F.raise_error(F.concat(F.lit("unknown relation: "), F.coalesce("relation", F.lit("null"))))).alias("relation"))
    own = nodes.where(F.col("language") == language)
    rank = own.join(in_file.select("lemma", F.lit(0).alias("_here")).distinct(), "lemma", "left")
    by_lemma = rank.groupBy("lemma").agg(F.min_by("id", F.struct(F.coalesce("_here", F.lit(1)), "id")).alias("id"))
    ends = checked.join(by_lemma.select(F.col("lemma").alias("from"), F.col("id").alias("from_id")), "from").join(by_lemma.select(F.col("lemma").alias("to"), F.col("id").alias("to_id")), "to")
    return existing.select("from_id", "to_id", "relation").union(ends.select("from_id", "to_id", "relation")).distinct()


def link_words(links: DataFrame, incoming: DataFrame, centroids: DataFrame) -> DataFrame:
    """links with the weights given, for centroids that are there; the last weight of a pair stands."""
    known = incoming.join(centroids.select(F.col("id").alias("centroid_id")), "centroid_id", "left_semi")
    both = links.select("lexical_node_id", "centroid_id", "weight", F.lit(0).alias("_age")).unionByName(known.select("lexical_node_id", "centroid_id", "weight", F.lit(1).alias("_age")))
    return both.groupBy("lexical_node_id", "centroid_id").agg(F.max_by("weight", "_age").alias("weight"))


def label_centroids(centroids: DataFrame, members: DataFrame, names: DataFrame, by_token: bool = False) -> DataFrame:
    """(centroid_id, label, score): of each active centroid the term of its members' names that sets it apart.

    centroids: (id, plugin_type); members: (centroid_id, member_id); names:
    (member_id, name). Terms are identifier words; frequency is of the centroid's
    own, document frequency counts active centroids of the type with a name that
    holds the term anywhere (``by_token``: as a word). Ties go to the term that
    more names begin with, then to the first by alphabet.
    """
    own = members.join(names, "member_id").join(centroids.select(F.col("id").alias("centroid_id"), "plugin_type"), "centroid_id").select("centroid_id", "plugin_type", "name")
    words = own.select("centroid_id", "plugin_type", F.posexplode(tokenize_identifier(F.col("name"))).alias("pos", "term"))
    tf = words.groupBy("centroid_id", "plugin_type", "term").agg(F.count("*").alias("n"), F.count_if(F.col("pos") == 0).alias("first"))
    total = tf.groupBy("centroid_id").agg(F.sum("n").alias("total"))
    if by_token:
        df = tf.groupBy("plugin_type", "term").agg(F.countDistinct("centroid_id").alias("df"))
    else:
        terms = tf.select("plugin_type", "term").distinct()
        # names are cut to their distinct parts before they meet the terms of their type
        texts = own.select("plugin_type", "centroid_id", F.lower("name").alias("text")).distinct()
        df = terms.join(texts, "plugin_type").where(F.contains(F.col("text"), F.col("term"))).groupBy("plugin_type", "term").agg(F.countDistinct("centroid_id").alias("df"))
    many = centroids.groupBy("plugin_type").agg(F.count("*").alias("many"))
    scored = tf.join(total, "centroid_id").join(df, ["plugin_type", "term"]).join(F.broadcast(many), "plugin_type")
    idf = F.log((1 + F.greatest(F.col("many"), F.lit(1))) / (1 + F.greatest(F.col("df"), F.lit(1)))) + 1
    scored = scored.withColumn("score", F.col("n") / F.col("total") * idf)
    order = Window.partitionBy("centroid_id").orderBy(F.desc(F.round("score", 6)), F.desc("first"), "term")
    best = scored.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select("centroid_id", F.col("term").alias("label"), "score")
