"""Global search: documents whose name holds all terms, or one of whose pages does; never terms of several put together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import textindex


def first_hits(pages: DataFrame, key: str, query: str) -> DataFrame:
    """pages (key, n, text): for each key with a hit its first page n, that page's text and how many more pages hit."""
    return firsts(pages.where(text.has_terms(text.fold(F.col("text")), text.terms_here(query))), key)


def firsts(hits: DataFrame, key: str) -> DataFrame:
    return hits.groupBy(key).agg(F.min("n").alias("n"), F.min_by("text", "n").alias("text"), (F.count("*") - 1).alias("more"))


def index(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, n, page_id, text): n is the page's place in its document's array before missing pages drop out."""
    return _listed(docs, pages.select(F.col("id").alias("page_id"), F.coalesce("texto", F.lit("")).alias("text")))


def _listed(docs: DataFrame, texts: DataFrame) -> DataFrame:
    listed = docs.where("papelera IS NULL").select(F.col("id").alias("doc_id"), F.posexplode("paginas").alias("pos", "page_id"))
    return listed.join(texts, "page_id").select("doc_id", (F.col("pos") + 1).alias("n"), "page_id", "text")


def search(docs: DataFrame, pages: DataFrame, folders: DataFrame, query: str, indexed: str | None = None) -> DataFrame:
    """docs (id, nombre, modificado, carpeta_id, papelera, paginas), pages (id, texto), folders (id, nombre).

    One row per document found: in_name, its first hit page n (null if only the name hits), more, and the snippet; newest first,
    ids break ties. A query without terms finds nothing. indexed: the folder of an index (textindex.write_segment) of the pages as (page_id, text), which is then read instead of the pages.
    """
    words = text.terms_here(query)
    live = docs.where("papelera IS NULL")
    named = live.select(F.col("id").alias("doc_id"), "nombre", "modificado", F.col("carpeta_id"), text.has_terms(text.fold(F.col("nombre")), words).alias("in_name"))
    if indexed is None:
        hits = first_hits(index(docs, pages), "doc_id", query)
    else:
        hits = firsts(_listed(docs, textindex.find(docs.sparkSession, indexed, query).select("page_id", "text")), "doc_id")
    names = folders.select(F.col("id").alias("carpeta_id"), F.col("nombre").alias("carpeta"))
    out = named.join(hits, "doc_id", "left").where("in_name OR n IS NOT NULL").join(names, "carpeta_id", "left")
    out = out.withColumn("hit", text.hit(F.col("text"), words)).withColumn("snippet", F.when(F.col("hit").isNotNull(), text.snippet(F.col("text"), F.col("hit.start"), F.col("hit.end"))))
    return out.select("doc_id", "nombre", "carpeta", "modificado", "in_name", "n", "more", "snippet").orderBy(F.desc("modificado"), "doc_id")
