"""A query for each operator that the catalogue's other queries don't exercise, on the test tables, with SQL that states the rule anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, dates, text
from ..operators import commands, highlights, layout, library
from ..sources import files, shared, zips
from .catalogue import NOW_MS, _shown, _store, ms, query, table

# Filters and listings


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def live_documents(spark, d):
    docs = table(spark, d, "orders").withColumn("papelera", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return library.live(docs).select("o_orderkey")


@query("SELECT c_custkey, 'there' AS asked FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, 'gone' FROM customer")
def documents_in_folder(spark, d):
    """Those of a folder; of all folders where the one asked for is gone."""
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("carpeta_id"))
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"))
    there = library.in_folder(docs, folders, 3).select("c_custkey", F.lit("there").alias("asked"))
    return there.unionByName(library.in_folder(docs, folders, 999).select("c_custkey", F.lit("gone").alias("asked")))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def point_lookup(spark, d):
    orders = table(spark, d, "orders")
    return library.by_key(orders, orders.agg(F.max("o_orderkey")).first()[0], "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT l_linenumber AS id, l_partkey FROM lineitem WHERE l_orderkey = (SELECT max(l_orderkey) FROM lineitem)")
def keys_of_parent(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.struct("l_linenumber", "l_partkey").alias("id"))
    return library.page_keys(lines, lines.agg(F.max("doc_id")).first()[0]).select(F.col("id.l_linenumber").alias("id"), "id.l_partkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber <> 4 AND l_discount < 0.025")
def blurry_pages(spark, d):
    lines = table(spark, d, "lineitem")
    pages = lines.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", "dibujo").otherwise("color").alias("filtro"), F.when(F.col("l_linenumber") != 4, F.col("l_discount") * 10).alias("nitidez"))
    return pages.where(library.blurry(pages)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linenumber NOT IN (1, 2) AND l_tax >= 0.03")
def comparable_pages(spark, d):
    n = F.col("l_linenumber")
    pages = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("papelera"), F.when(n == 1, "portada").when(n == 2, "pdf").when(n == 3, "libro").alias("modo"), F.when(F.col("l_tax") < 0.03, True).alias("no_repetida"))
    return pages.where(library.comparable(pages)).select("l_orderkey", "l_linenumber")


@query("WITH l AS (SELECT conv_id, list(conv_id * 1000 + turn) AS p FROM conversations GROUP BY conv_id) SELECT c.conv_id, turn, turn > 0 AND list_contains(p, c.conv_id * 1000 + 2 * turn - 1) AS valid FROM conversations c JOIN l USING (conv_id)")
def still_repeated_pages(spark, d):
    """Whether the page that a page was found to repeat is still in its document."""
    docs, pages = _store(spark, d)
    joined = pages.join(docs.select(F.col("id").alias("doc_id"), "paginas"), "doc_id")
    turn = F.col("id") % 1000
    flag = F.when(turn > 0, F.col("doc_id") * 1000 + 2 * turn - 1)
    return joined.select(F.col("doc_id").alias("conv_id"), turn.alias("turn"), library.still_repeated(flag, F.col("paginas")).alias("valid"))


@query("SELECT DISTINCT conv_id AS id FROM conversations WHERE conv_id % 5 <> 0 AND conv_id <> 7")
def mergeable_documents(spark, d):
    return library.mergeable(_store(spark, d)[0], 7).select("id")


@query("SELECT l_orderkey, bool_or(l_returnflag = 'N' AND l_linestatus = 'O') AS has FROM lineitem GROUP BY l_orderkey")
def highlighted_pages(spark, d):
    kind = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "resaltador").otherwise("lapiz")
    marks = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(kind.alias("tipo"))).alias("marcas"))
    return marks.select("l_orderkey", library.has_highlights(F.col("marcas")).alias("has"))


_QUAD = ("l_partkey % 97", "l_suppkey % 89", "100 + l_partkey % 83", "l_orderkey % 79", "100 + l_suppkey % 61", "100 + l_orderkey % 59", "l_orderkey % 101", "100 + l_partkey % 53")


@query("WITH q AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{v} AS {'xy'[k % 2]}{k // 2}" for k, v in enumerate(_QUAD)) + " FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, ["
    + ", ".join(f"(x{b} - x{a}) * (y{c} - y{b}) - (y{b} - y{a}) * (x{c} - x{b})" for a, b, c in ((0, 1, 2), (1, 2, 3), (2, 3, 0), (3, 0, 1))) + "] AS t FROM q) SELECT l_orderkey, l_linenumber, list_min(t) > 0 OR list_max(t) < 0 AS convex FROM t")
def convex_corners(spark, d):
    v = [F.expr(x) for x in _QUAD]
    corners = F.array(*[F.struct(v[k].alias("x"), v[k + 1].alias("y")) for k in (0, 2, 4, 6)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", library.convex(corners).alias("convex"))


@query("SELECT l_orderkey, CAST(CASE WHEN least(d0, d1, d2, d3) > 44 THEN NULL WHEN d0 <= least(d1, d2, d3) THEN 0 WHEN d1 <= least(d2, d3) THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS INTEGER) AS corner, l_linenumber FROM (SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"sqrt(pow({_QUAD[2 * k]} - l_partkey % 200, 2) + pow({_QUAD[2 * k + 1]} - l_suppkey % 200, 2)) AS d{k}" for k in range(4)) + " FROM lineitem)")
def corner_under_pointer(spark, d):
    v = [F.expr(x) for x in _QUAD]
    corners = F.array(*[F.struct(v[k].alias("x"), v[k + 1].alias("y")) for k in (0, 2, 4, 6)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", highlights.nearest_corner(corners, F.expr("l_partkey % 200"), F.expr("l_suppkey % 200")).alias("corner"))


@query("SELECT l_orderkey, max(CASE WHEN l_linenumber = 3 AND l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 AS has_cover FROM lineitem GROUP BY l_orderkey")
def documents_with_cover(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when((F.col("l_linenumber") == 3) & (F.col("l_returnflag") == "N"), "portada").alias("modo"))
    return library.has_cover(pages).select(F.col("doc_id").alias("l_orderkey"), "has_cover")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE left(lower(a.n_name), 2) = left(lower(b.n_name), 2)")
def same_names(spark, d):
    """Names, cut to two letters, equal but for accents and capitals."""
    n = table(spark, d, "nation")
    plain = n.select(F.col("n_nationkey").alias("a"), F.left("n_name", F.lit(2)).alias("x"))
    marked = n.select(F.col("n_nationkey").alias("b"), F.translate(F.lower(F.left("n_name", F.lit(2))), "aeiou", "áéíóú").alias("y"))
    return plain.join(marked, library.same_name(F.col("x"), F.col("y"))).select("a", "b")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY came, event_type) AS codes FROM (SELECT user_id, event_type, min(ts) AS came FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def distinct_codes(spark, d):
    """Each user's codes, once each, in the order in which they came first."""
    return library.distinct_in_order(table(spark, d, "events"), "user_id", "event_type", "ts", "codes").select("user_id", F.array_join("codes", ",").alias("codes"))


@query("SELECT l_orderkey, avg(CASE WHEN l_partkey >= l_suppkey * 20 THEN 1.0 ELSE 0.0 END) >= 0.5 AS upright FROM lineitem GROUP BY l_orderkey")
def upright_documents(spark, d):
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("alto"), (F.col("l_suppkey") * 20).alias("ancho"))
    return library.sheet_orientation(pages).select(F.col("doc_id").alias("l_orderkey"), "upright")


@query("SELECT l_orderkey, min(l_partkey) AS x0, min(l_suppkey) AS y0, max(l_partkey) AS x1, max(l_suppkey) AS y1 FROM lineitem GROUP BY l_orderkey")
def bounding_boxes(spark, d):
    drawn = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.flatten(F.collect_list(F.array("l_partkey", "l_suppkey"))).alias("points"))
    return drawn.select("l_orderkey", highlights.bounding_box(F.col("points")).alias("b")).select("l_orderkey", "b.*")


# Text


@query("SELECT conv_id, CAST(turn + 1 AS INTEGER) AS n, text FROM conversations")
def pages_of_exported_text(spark, d):
    """Texts put together with headers, and parted by them again."""
    pages = table(spark, d, "conversations").select("conv_id", F.struct((F.col("turn") + 1).alias("n"), "text").alias("p"))
    whole = pages.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("conv_id", text.with_page_headers(F.col("p")).alias("body"))
    return whole.select("conv_id", F.inline(text.split_by_headers(F.col("body"))))


@query("SELECT conv_id, count(*) AS translated, CAST(sum(length(text)) AS BIGINT) AS letters FROM conversations GROUP BY conv_id")
def translated_segments(spark, d):
    """What is sent to a translator of an exported text: the pages, without their headers and the blank lines between them."""
    pages = table(spark, d, "conversations").select("conv_id", F.struct((F.col("turn") + 1).alias("n"), "text").alias("p"))
    whole = pages.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("conv_id", text.with_page_headers(F.col("p")).alias("body"))
    parts = whole.select("conv_id", F.inline(text.translation_segments(F.col("body")))).where("translate")
    return parts.groupBy("conv_id").agg(F.count("*").alias("translated"), F.sum(F.length("text")).alias("letters"))


@query("SELECT c_custkey, '<FEFF' || regexp_replace(hex(encode(c_name)), '(..)', '00\\1', 'g') || '>' AS title FROM customer")
def pdf_titles(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.pdf_title(F.col("c_name")).alias("title"))


@query("SELECT p_partkey, p_name AS said FROM part")
def spoken_lines(spark, d):
    """Lines of lists without what marks them."""
    mark = F.element_at(F.array(*map(F.lit, ("• ", "  - ", "– ", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.without_bullet(F.concat(mark, "p_name")).alias("said"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN c_name ELSE '' END AS topic FROM customer")
def topics(spark, d):
    """A document's topic is its name, unless that was made from the folder's or the date."""
    k = F.col("c_custkey") % 3
    name = F.when(k == 0, "Escaneo 3 ene 2024").when(k == 1, F.concat("c_mktsegment", F.lit(" 2"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", text.topic(name, F.col("c_mktsegment")).alias("topic"))


@query("SELECT doc_id, CAST(position('the' IN substr(text, 41)) + CASE WHEN position('the' IN substr(text, 41)) > 0 THEN 39 ELSE -1 END AS INTEGER) AS place FROM documents")
def spoken_word_places(spark, d):
    """Where a word stands from the fortieth character on."""
    return table(spark, d, "documents").select("doc_id", text.next_place(F.col("text"), F.lit("the"), F.lit(40)).alias("place"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN o_clerk WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority ELSE o_orderstatus END AS materia FROM (SELECT *, 'c' || (o_custkey % 9) AS o_clerk FROM orders)")
def cover_forms(spark, d):
    """A cover form's field: the cover's as it is, else the profile's, else the class's."""
    one = lambda c: F.struct(c.alias("materia"))
    orders = table(spark, d, "orders").withColumn("clerk", F.concat(F.lit("c"), (F.col("o_custkey") % 9).cast("string")))
    docs = orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", one(F.col("clerk"))).alias("actual"), one(F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).otherwise("")).alias("perfil"), one(F.col("o_orderstatus")).alias("clase"))
    return library.cover_defaults(docs, ["materia"]).select("o_orderkey", "portada.materia")


@query("SELECT page_id, page_id % 3 = 0 OR regexp_matches(url, '(?i)\\.pdf$') OR page_id % 3 = 1 AS pdf, trim(replace('a_b ' || page_id, '_', ' ')) AS name FROM pages")
def pdf_files(spark, d):
    k = F.col("page_id") % 3
    mime, name = F.when(k == 0, "application/pdf"), F.when(k == 1, F.concat("url", F.lit(".PDF"))).otherwise(F.col("url"))
    own = F.concat(F.lit("a_b "), F.col("page_id").cast("string"), F.lit(".Pdf"))
    return table(spark, d, "pages").select("page_id", text.is_pdf(mime, name).alias("pdf"), text.pdf_document_name(own).alias("name"))


@query("WITH RECURSIVE t AS (SELECT page_id, url AS rest, 0 AS n, 0 AS longest FROM pages UNION ALL SELECT page_id, substr(rest, 13), n + 1, greatest(longest, length(substr(rest, 1, 12))) FROM t WHERE length(rest) > 0) SELECT page_id, CAST(max(n) AS INTEGER) AS lines, CAST(max(longest) AS INTEGER) AS longest FROM t GROUP BY page_id")
def wrapped_notes(spark, d):
    """A note without spaces on lines of twelve letters, by a font in which all are as wide."""
    wrap = text.wrapped(12.0, {"a": 1.0}, 1.0)
    return table(spark, d, "pages").select("page_id", wrap("url").alias("l")).select("page_id", F.size("l").alias("lines"), F.array_max(F.transform("l", lambda x: F.length(x))).alias("longest"))


_WORDS_SQL = r"""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations),
u AS (SELECT conv_id, turn, unnest(w) AS t, generate_subscripts(w, 1) AS k FROM w), c AS (SELECT *, (length(t) * 13 + k * 7) % 101 AS sure, length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) AS letters FROM u),
g AS (SELECT * FROM c WHERE regexp_matches(t, '[\p{L}\p{N}]') AND (sure >= 25 OR sure >= 10 AND regexp_matches(t, '^[¿¡("“«]?\p{Lu}?\p{Ll}{4,}[.,;:)?!"”»-]?$'))),
e AS (SELECT conv_id, turn, max(k) AS last FROM g WHERE NOT (letters <= 3 AND sure < 75) GROUP BY conv_id, turn), h AS (SELECT g.* FROM g JOIN e USING (conv_id, turn) WHERE k <= last),
b AS (SELECT conv_id, turn, min(k) AS first FROM h WHERE NOT (letters <= 2 AND sure < 50) GROUP BY conv_id, turn)
SELECT w.conv_id, w.turn, coalesce(string_agg(h.t, ' ' ORDER BY k), '') AS kept FROM w LEFT JOIN b USING (conv_id, turn) LEFT JOIN h ON h.conv_id = w.conv_id AND h.turn = w.turn AND h.k >= b.first GROUP BY w.conv_id, w.turn
"""


def _read_words(said: F.Column) -> F.Column:
    return F.transform(F.split(said, " "), lambda t, k: F.struct(t.alias("text"), ((F.length(t) * 13 + (k + 1) * 7) % 101).cast("double").alias("confidence"), F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(9).alias("x1"), F.lit(9).alias("y1")).alias("bbox")))


@query(_WORDS_SQL)
def reliable_words(spark, d):
    """Words that a reading of some confidence is believed for, without doubtful scraps at the ends of a line."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", _read_words(F.col("text")).alias("w"))
    return turns.select("conv_id", "turn", F.array_join(F.transform(layout.reliable_words(F.col("w")), lambda w: w["text"]), " ").alias("kept"))


@query("WITH k AS (SELECT * FROM (" + _WORDS_SQL + ") WHERE kept <> '') SELECT conv_id, string_agg(kept, chr(10) || chr(10) ORDER BY turn) AS body FROM k GROUP BY conv_id")
def read_pages(spark, d):
    """The text of a reading's tree: each turn is a paragraph of one line; what has no believed word is left out."""
    line = lambda said: F.struct(F.struct(F.lit(0).alias("y0"), F.lit(9).alias("y1")).alias("bbox"), F.struct(F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(9).alias("x1"), F.lit(9).alias("y1")).alias("baseline"), F.lit(95.0).alias("confidence"), _read_words(said).alias("words"))
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    tree = F.array(F.struct(F.transform("turns", lambda t: F.struct(F.array(line(t["text"])).alias("lines"))).alias("paragraphs")))
    # A generator, so that the condition doesn't read the tree once more.
    return turns.select("conv_id", F.explode(F.array(layout.read_tree(tree)["text"])).alias("body")).where("body <> ''")


# Times

_MONTHS = "['ene', 'feb', 'mar', 'abr', 'may', 'jun', 'jul', 'ago', 'sept', 'oct', 'nov', 'dic'][month(ts)]"


@query(f"SELECT event_id, CASE WHEN CAST(ts AS DATE) = CAST('2024-01-20' AS DATE) THEN 'Hoy, ' || strftime(ts, '%-I:%M %p') ELSE day(ts) || ' ' || {_MONTHS} || ' ' || year(ts) END AS label FROM events")
def short_dates(spark, d):
    return table(spark, d, "events").select("event_id", dates.short_date(ms(F.col("ts")), F.lit(1_705_752_000_000)).alias("label"))


@query(f"SELECT event_id, 'Escaneo ' || day(ts) || ' ' || {_MONTHS} || ' ' || year(ts) || strftime(ts, ' %H.%M') AS name, strftime(ts, '%d/%m/%Y') AS stamp, day(ts) || ' de ' || ['enero', 'febrero', 'marzo', 'abril', 'mayo', 'junio', 'julio', 'agosto', 'septiembre', 'octubre', 'noviembre', 'diciembre'][month(ts)] || ' de ' || year(ts) AS long FROM events")
def default_names(spark, d):
    t = ms(F.col("ts"))
    return table(spark, d, "events").select("event_id", dates.default_name(t).alias("name"), dates.day_stamp(t).alias("stamp"), dates.long_date(t).alias("long"))


@query("SELECT event_id, CAST((year(ts) - 1980) * 512 + month(ts) * 32 + day(ts) AS INTEGER) AS day, CAST(hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 AS INTEGER) AS time, strftime(ts, 'D:%Y%m%d%H%M%S') AS pdf FROM events")
def packed_dates(spark, d):
    t = ms(F.col("ts"))
    return table(spark, d, "events").select("event_id", dates.dos_date(t).alias("p"), dates.pdf_date(t).alias("pdf")).select("event_id", "p.day", "p.time", "pdf")


# Geometry


@query("WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey % 50 AS px, l_suppkey % 50 AS py, l_orderkey % 50 AS ax, 7 AS ay, l_partkey % 31 AS dx, l_suppkey % 3 AS dy FROM lineitem), t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, CAST((px - ax) * dx + (py - ay) * dy AS DOUBLE) / (dx * dx + dy * dy))) END AS t FROM s) SELECT l_orderkey, l_linenumber, round(sqrt(pow(px - ax - t * dx, 2) + pow(py - ay - t * dy, 2)), 6) AS far FROM t")
def segment_distances(spark, d):
    p, s, o = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    far = arrays.segment_distance(p % 50, s % 50, o % 50, F.lit(7), o % 50 + p % 31, 7 + s % 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(far, 6).alias("far"))


@query("SELECT o_orderkey, round(1 - o_orderkey % 64 / 64.0, 9) AS x, round(o_custkey % 64 / 64.0, 9) AS y, CAST((o_custkey % 7 + 1) * 0.5 AS DOUBLE) AS thickness, CAST(500 AS DOUBLE) AS width FROM orders")
def turned_marks(spark, d):
    """A quarter turn: what was across is down, and thickness, a share of the width, is that of the new one."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    strokes = table(spark, d, "orders").select("o_orderkey", F.array(c % 64 / 64.0, k % 64 / 64.0).alias("points"), ((c % 7 + 1) * 0.25).alias("thickness"), F.lit(1000.0).alias("width"), F.lit(500.0).alias("height"))
    t = highlights.turn_strokes(strokes, 1)
    return t.select("o_orderkey", F.round(F.get("points", F.lit(0)), 9).alias("x"), F.round(F.get("points", F.lit(1)), 9).alias("y"), F.round("thickness", 9).alias("thickness"), "width")


@query("WITH b AS (SELECT l_orderkey, min(l_partkey) AS x0, max(l_partkey) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round((y1 - y0 + 4.0) / (x1 - x0 + 4.0), 9) AS aspect, round(2.0 / (x1 - x0 + 4.0), 9) AS thickness FROM b WHERE n >= 2 AND (x1 - x0 + 4 >= 8 OR y1 - y0 + 4 >= 8)")
def signatures(spark, d):
    drawn = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array(F.flatten(F.collect_list(F.array(F.col("l_partkey").cast("double"), F.col("l_suppkey").cast("double"))))).alias("strokes"))
    made = drawn.select("l_orderkey", highlights.normal_signature(F.col("strokes"), F.lit(2.0)).alias("s")).where("s IS NOT NULL")
    return made.select("l_orderkey", F.round("s.aspect", 9).alias("aspect"), F.round("s.thickness", 9).alias("thickness"))


# Commands


def _few(spark, d):
    """Conversations as documents, their turns as pages with a time."""
    docs, pages = _store(spark, d)
    return docs, pages.withColumn("creada", F.col("id") + 5)


@query("SELECT conv_id * 1000 + turn AS id, conv_id AS doc_id, conv_id * 1000 + turn + 5 AS creada, CASE WHEN turn = 1 THEN 'new' ELSE text END AS text FROM conversations")
def replaced_pages(spark, d):
    """New content for every second page; its document and time stay."""
    number = F.col("conv_id") * 1000 + F.col("turn")  # not a key: a conversation may have more turns than that
    pages = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("conv_id").alias("doc_id"), "text", (number + 5).alias("creada"))
    new = pages.where("id.turn = 1").select("id", F.lit(-1).cast("long").alias("doc_id"), F.lit("new").alias("text"), F.lit(None).cast("long").alias("creada"))
    return commands.replace_page(pages, new).select((F.col("id.conv_id") * 1000 + F.col("id.turn")).alias("id"), "doc_id", "creada", "text")


@query("SELECT id, doc_id FROM (SELECT conv_id * 1000 + turn AS id, conv_id AS doc_id FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT DISTINCT conv_id * 1000 + 500, conv_id FROM conversations WHERE conv_id % 2 = 1)")
def replaced_documents(spark, d):
    """Every second document anew, with one page."""
    docs, pages = _few(spark, d)
    new = docs.where("id % 2 = 1").withColumn("paginas", F.array(F.col("id") * 1000 + 500))
    own = new.select(F.element_at("paginas", 1).alias("id"), F.col("id").alias("doc_id"))
    return commands.replace_document(docs, pages, new, own)[1].select("id", "doc_id")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_nationkey END AS carpeta_id, (SELECT count(*) FROM nation WHERE n_nationkey <> 3) AS folders FROM customer")
def deleted_folder(spark, d):
    folders, docs = commands.delete_folder(table(spark, d, "nation").select(F.col("n_nationkey").alias("id")), table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("carpeta_id")), 3)
    return docs.join(folders.agg(F.count("*").alias("folders")), how="cross")  # one row


@query("SELECT count(*) FILTER (WHERE false) AS rows FROM orders")
def dropped_database(spark, d):
    orders, lines = commands.delete_database(table(spark, d, "orders"), table(spark, d, "lineitem"))
    return orders.select("o_orderkey").unionByName(lines.select(F.col("l_orderkey").alias("o_orderkey"))).agg(F.count("*").alias("rows"))


@query("SELECT conv_id * 1000 + turn AS id FROM conversations WHERE NOT (conv_id = 7 AND turn = 0)")
def deleted_from_trash(spark, d):
    """Of two pages only the one in the trash goes."""
    docs, pages = _store(spark, d)
    _, pages = commands.trash_pages(docs, pages, 7, [7000], NOW_MS)
    for page in (7000, 7001):
        pages = commands.delete_trashed_page(pages, page)
    return pages.select("id")


@query("WITH p AS (SELECT conv_id AS id, list(conv_id * 1000 + turn ORDER BY turn) AS p FROM conversations GROUP BY conv_id) SELECT id, CAST(CASE WHEN id = 2 THEN list_concat([2000, 9999], p[2:]) ELSE p END AS VARCHAR) AS pages FROM p")
def split_books(spark, d):
    """A page that shows an open book becomes two."""
    docs, pages = _store(spark, d)
    left = pages.where("id = 2000").withColumn("text", F.lit("left"))
    right = left.withColumns({"id": F.lit(9999).cast("long"), "text": F.lit("right")})
    return commands.split_book(docs, pages, 2000, left, right, NOW_MS)[0].select("id", _shown(F.col("paginas")))


@query("SELECT conv_id * 1000 + turn AS id, conv_id AS doc_id, CASE WHEN conv_id = 3 AND turn = 1 THEN 'new cover' ELSE text END AS text FROM conversations UNION ALL SELECT 99999, 4, 'new cover'")
def saved_covers(spark, d):
    """A document's cover gets new content; one without a cover gets a first page."""
    docs, pages = _few(spark, d)
    pages = pages.withColumn("modo", F.when(F.col("id") == 3001, "portada"))
    cover = pages.limit(1).withColumns({"id": F.lit(99999).cast("long"), "text": F.lit("new cover"), "modo": F.lit("portada")})
    docs, pages = commands.save_cover(docs, pages, 3, cover, NOW_MS)
    return commands.save_cover(docs, pages, 4, cover, NOW_MS)[1].select("id", "doc_id", "text")


@query(f"SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id = 3 AND turn = 1 THEN 90 ELSE 0 END AS rotacion, CASE WHEN conv_id = 3 AND turn = 1 THEN 12 WHEN turn = 1 THEN 5 ELSE 0 END AS brillo, NOT (conv_id = 3 AND turn = 1) AS read, CASE WHEN conv_id = 3 THEN {NOW_MS} ELSE conv_id * 1000 END AS changed FROM conversations")
def reprocessed_pages(spark, d):
    """One page turned and lightened: its read text goes, what isn't said stays, and its document has changed."""
    docs, pages = _store(spark, d)
    pages = pages.withColumns({"rotacion": F.lit(0), "brillo": F.when(F.col("id") % 1000 == 1, 5).otherwise(0), "ocr": F.struct(F.lit("spa").alias("idioma"))})
    docs = commands.touch_document_of(docs, pages, 3001, NOW_MS)
    pages = commands.reprocess(pages, 3001, {"rotacion": 90, "brillo": 12})
    changed = docs.select(F.col("id").alias("doc_id"), F.col("modificado").alias("changed"))
    return pages.join(changed, "doc_id").select("id", "rotacion", "brillo", F.col("ocr").isNotNull().alias("read"), "changed")


@query(f"SELECT conv_id * 1000 + turn AS id, CASE WHEN conv_id = 4 AND turn = 0 THEN 'nota' END AS kind, CASE WHEN conv_id = 4 THEN {NOW_MS} ELSE conv_id * 1000 END AS changed FROM conversations")
def saved_marks(spark, d):
    """Marks on one page; its document has changed."""
    docs, pages = _store(spark, d)
    pages = pages.withColumn("marcas", F.lit(None).cast("array<struct<tipo:string>>"))
    docs = commands.touch_document_of(docs, pages, 4000, NOW_MS)
    pages = commands.save_marks(pages, 4000, F.array(F.struct(F.lit("nota").alias("tipo"))))
    return pages.join(docs.select(F.col("id").alias("doc_id"), F.col("modificado").alias("changed")), "doc_id").select("id", F.get("marcas", F.lit(0))["tipo"].alias("kind"), "changed")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'espera=9,huella=h,otro=x,pin=p' WHEN 1 THEN 'espera=60000,fallos=2,otro=x,pin=' || c_custkey ELSE 'otro=x' END AS settings FROM customer")
def lock_changes(spark, d):
    """A new PIN forgets failures; a new wait without the fingerprint; no lock at all."""
    c, k = table(spark, d, "customer"), F.col("c_custkey") % 3
    of = lambda **x: F.create_map(*[v if isinstance(v, F.Column) else F.lit(v) for kv in x.items() for v in kv])
    before = of(otro="x", pin=F.col("c_custkey").cast("string"), espera="9", huella="h", fallos="2")
    after = F.when(k == 0, commands.lock_settings(before, pin="p")).when(k == 1, commands.lock_settings(before, wait_ms=60_000, without_fingerprint=True)).otherwise(commands.lock_settings(before, removed=True))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(after), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return c.select("c_custkey", shown.alias("settings"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a=1,b=y' WHEN 1 THEN 'a=1,b=2' ELSE 'a=1,b=2' END AS settings FROM customer")
def stored_settings(spark, d):
    """What is stored over the defaults, without old keys; text that isn't JSON counts as nothing."""
    stored = F.element_at(F.array(F.lit('{"b": "y", "nube": "old"}'), F.lit("no json"), F.lit(None).cast("string")), (F.col("c_custkey") % 3 + 1).cast("int"))
    got = library.settings(stored, {"a": "1", "b": "2"}, removed=("nube",))
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries(got), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("settings"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey % 60000 AS INTEGER) AS width, CAST(l_suppkey AS INTEGER) AS height, CAST(3 AS INTEGER) AS channels FROM lineitem")
def jpeg_headers(spark, d):
    """Sizes from the frame headers of JPEG files, of which the start is made from each line's numbers."""
    size = lambda c: F.lpad(F.hex(c), 4, "0")
    made = F.unhex(F.concat(F.lit("FFD8FFE000040102FFC0000B08"), size(F.col("l_suppkey")), size(F.col("l_partkey") % 60000), F.lit("03011100FFD9")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", files.jpeg_sizes()(made).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("SELECT 'pages/' || page_id || '.html' AS name, octet_length(encode(coalesce(html, ''))) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages")
def archived_pages(spark, d):
    """Pages written to one archive by many tasks, and read back entry by entry."""
    entries = table(spark, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    path = f"{shared.workdir(spark, 'archive')}.zip"
    zips.write_zip(entries, path, part_bytes=1 << 20)
    read = zips.read_zips(spark, path, task_bytes=1 << 20)
    return read.select("name", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))
