"""Queries over the test tables, each with the SQL that must give the same rows.

The library's tables stand on the test tables as follows: a document is a conversation (its pages are the turns) or an order (its
lines are the pages), a page's text is documents.text, a folder is a source or a nation, codes are pages.url, and fingerprints are
embeddings. The current time is a constant.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, codes, dates, text
from ..operators import commands, highlights, library, search, textindex
from ..sources import files, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2024-02-10 00:00:00"
NOW_MS = 1_707_523_200_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ms(c) -> F.Column:
    return F.unix_millis(c.cast("timestamp"))


# Search


@query("SELECT doc_id, text AS body FROM documents WHERE contains(lower(strip_accents(text)), 'the') AND contains(lower(strip_accents(text)), 'and')")
def search_and_substring(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.has_terms(text.fold(F.col("text")), text.terms_here("THE  and"))).select("doc_id", F.col("text").alias("body"))


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(strip_accents(text)), 'cion') AND contains(lower(strip_accents(text)), 'que')")
def search_accent_insensitive(spark, d):
    docs = table(spark, d, "documents")
    return docs.where(text.has_terms(text.fold(F.col("text")), text.terms_here("ción QUÉ"))).select("doc_id", "lang")


@query("SELECT conv_id, min(turn) + 1 AS first_n, count(*) - 1 AS more FROM conversations WHERE contains(lower(strip_accents(text)), 'the') GROUP BY conv_id")
def search_first_hit_per_document(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", (F.col("turn") + 1).alias("n"), "text")
    return search.first_hits(pages, "conv_id", "THE").select("conv_id", F.col("n").alias("first_n"), "more")


_SNIPPET_SQL = r"""
WITH h AS (SELECT doc_id, text, position('the' IN lower(strip_accents(text))) AS p FROM documents WHERE contains(lower(strip_accents(text)), 'the')),
c AS (SELECT doc_id, substr(text, 1, p - 1) AS l, substr(text, p, 3) AS m, substr(text, p + 3) AS r FROM h),
s AS (SELECT *, regexp_extract(l, '(?s)\S{0,15}.{0,45}\z', 0) AS b, regexp_extract(r, '(?s)^.{0,45}\S{0,15}', 0) AS a FROM c)
SELECT doc_id, CASE WHEN length(b) < length(l) THEN '…' ELSE '' END || ltrim(regexp_replace(b, '\s+', ' ', 'g')) AS before, regexp_replace(m, '\s+', ' ', 'g') AS mark,
rtrim(regexp_replace(a, '\s+', ' ', 'g')) || CASE WHEN length(a) < length(r) THEN '…' ELSE '' END AS after FROM s
"""


@query(_SNIPPET_SQL)
def search_snippet(spark, d):
    """The library's search with the page's excerpt around the first term."""
    hits = text.with_hits(table(spark, d, "documents").select("doc_id", "text"), "text", text.terms_here("the"))
    return hits.select("doc_id", text.snippet(F.col("text"), F.col("hit.start"), F.col("hit.end")).alias("s")).select("doc_id", "s.before", "s.mark", "s.after")


#: Where the folded text's character stands: the prefix of letters with their marks that is so many letters long.
_OFFSETS_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(text, '([aeiouAEIOU])', '\1' || chr(769), 'g') AS marked FROM documents),
h AS (SELECT *, position('the' IN lower(strip_accents(marked))) AS p FROM t),
w AS (SELECT doc_id, p, regexp_extract_all(marked, '\PM\pM*') AS letters, length(regexp_extract(marked, '^\pM+')) AS lead FROM h WHERE p > 0)
SELECT doc_id, CAST(lead + length(array_to_string(letters[:p - 1], '')) AS INTEGER) AS start, CAST(lead + length(array_to_string(letters[:p + 1], '')) + 1 AS INTEGER) AS end_ FROM w
"""


@query(_OFFSETS_SQL)
def search_offsets_in_marked_text(spark, d):
    """Places in texts whose vowels have combining accents: those of the text itself, not of the folded one."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "([aeiouAEIOU])", "$1́").alias("marked"))
    hits = text.with_hits(docs, "marked", text.terms_here("the"))
    return hits.select("doc_id", F.col("hit.start").alias("start"), F.col("hit.end").alias("end_"))


#: Small letters become a voiced kana, two Hangul syllables, a Greek capital sigma and a Georgian capital.
_SCRIPTS = "translate(text, 'aeiou', 'が가각ΣᲐ')"


@query(f"SELECT doc_id, replace(replace(translate(lower(strip_accents(translate(text, 'aeiou', '\x01\x02\x03\x04\x05'))), '\x01\x04\x05', 'かσა'), '\x02', chr(4352) || chr(4449)), '\x03', chr(4352) || chr(4449) || chr(4520)) AS norm FROM documents")
def fold_scripts(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.expr(_SCRIPTS)).alias("norm"))


@query("""WITH h AS (SELECT doc_id, position('th' || '\x02' IN lower(strip_accents(translate(text, 'aeiou', '\x01\x02\x02\x03\x04')))) AS p FROM documents)
SELECT doc_id, CAST(p - 1 AS INTEGER) AS start, CAST(p + 2 AS INTEGER) AS end_ FROM h WHERE p > 0""")
def search_offsets_in_syllables(spark, d):
    """Places in texts with Hangul syllables, which fold to several letters each: those of the syllables."""
    docs = table(spark, d, "documents").select("doc_id", F.expr(_SCRIPTS).alias("written"))
    hits = text.with_hits(docs, "written", text.terms_here("TH가"))
    return hits.select("doc_id", F.col("hit.start").alias("start"), F.col("hit.end").alias("end_"))


@query("SELECT doc_id, lower(strip_accents(text)) AS norm FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.fold(F.col("text")).alias("norm"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality = 1 WHERE l.doc_id IS NULL")
def unread_pages(spark, d):
    read = table(spark, d, "labels").where("quality = 1")
    return library.unread(table(spark, d, "documents"), read, "doc_id")


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS unread, count(*) AS pages FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def unread_count(spark, d):
    return library.unread_count(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query(r"SELECT doc_id, len(list_filter(string_split_regex(lower(strip_accents(text)), '\s+'), lambda x: x <> '')) AS n_terms FROM documents")
def query_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.terms(F.col("text"))).cast("long").alias("n_terms"))


#: Sets of terms that the index is asked for: rare and common ones, accents and capitals, several terms, terms of one and two letters, and some that nothing has.
TERM_SETS = ("CIÓN que", "the AND of", "straße", "un", "q", "x ñ", "el qu er", "copyright licencia", "zqxj", "a zqxj", "licensed apache")


def _folded(query: str) -> str:
    return " AND ".join(f"contains(norm, '{w}')" for w in text.terms_here(query))


def _indexed(spark, d) -> str:
    """An index of all documents, in two segments."""
    root = shared.workdir(spark, "textindex")
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    for part in (docs.where("lang = 'en'"), docs.where("lang IS DISTINCT FROM 'en'")):
        textindex.write_segment(part, root)
    return root


@query("WITH t AS (SELECT doc_id, lower(strip_accents(text)) AS norm FROM documents) " + " UNION ALL ".join(
    f"SELECT '{q}' AS query, doc_id, CAST(position('{text.terms_here(q)[0]}' IN norm) - 1 AS INTEGER) AS start FROM t WHERE {_folded(q)}" for q in TERM_SETS))
def search_by_index(spark, d):
    """All-terms search through posting lists, for several sets of terms."""
    root = _indexed(spark, d)
    found = [textindex.find(spark, root, q).select(F.lit(q).alias("query"), "doc_id", F.col("hit.start").alias("start")) for q in TERM_SETS]
    return reduce(DataFrame.unionByName, found)


@query("WITH t AS (SELECT lower(strip_accents(text)) AS norm, lang = 'en' AS english FROM documents), g AS (SELECT unnest([" + ", ".join(f"'{g}'" for g, _ in textindex.needs(text.terms_here(" ".join(TERM_SETS))) if len(g) == 3) + """]) AS gram)
SELECT gram, count(*) FILTER (WHERE contains(norm, gram)) AS texts FROM g, t GROUP BY gram""")
def index_postings(spark, d):
    """How many texts have each gram of the terms, as the index's segments count them together; 0 where none does."""
    root = _indexed(spark, d)
    grams = [g for g, _ in textindex.needs(text.terms_here(" ".join(TERM_SETS))) if len(g) == 3]
    wanted = spark.range(1).select(F.explode(F.array(*map(F.lit, grams))).alias("gram"))
    counted = reduce(DataFrame.unionByName, [spark.read.parquet(f"{root}/{s}/grams") for s in textindex.segments(spark, root)])
    return wanted.join(counted, "gram", "left").groupBy("gram").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("texts"))


# Listings and joins


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def list_documents_newest(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus <> 'F'")
    return library.newest(orders, "o_orderdate", "o_orderkey", 50).select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey, o_orderdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def ordered_children_join(spark, d):
    lines = table(spark, d, "lineitem")
    lines = lines.withColumn("id", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    listed = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("id")).alias("paginas"))
    docs = table(spark, d, "orders").join(listed, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), "paginas", "o_orderdate")
    pages = library.pages_of(docs, lines.select("id", "l_partkey"), carry=("o_orderdate",))
    return pages.select(F.col("of").alias("l_orderkey"), F.col("n").cast("long").alias("n"), "l_partkey", "o_orderdate")


@query("SELECT conv_id, arg_min(text, turn) AS first_page FROM conversations GROUP BY conv_id")
def first_child(spark, d):
    docs, pages = _store(spark, d)
    return library.cover_page(docs, pages.withColumnRenamed("text", "miniatura")).select(F.col("id").alias("conv_id"), F.col("miniatura").alias("first_page"))


@query("SELECT c_custkey, n_name AS folder FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def folder_left_join(spark, d):
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("folder_id"), F.col("n_name").alias("folder"))
    docs = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("folder_id"))
    return library.with_folder(docs, folders).select("c_custkey", "folder")


@query("SELECT n_name AS folder, count(c_custkey) AS documents FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def folder_counts(spark, d):
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("folder"))
    return library.folder_counts(folders, table(spark, d, "customer").select(F.col("c_nationkey").alias("carpeta_id"))).select("folder", "documents")


@query("SELECT n_nationkey, CASE WHEN r_regionkey IS NULL THEN NULL ELSE n_regionkey END AS folder_id FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def dangling_fk_to_null(spark, d):
    folders = table(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("folder_id"))
    return library.without_dangling_folder(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("folder_id")), folders)


@query("""SELECT 'document' AS kind, o_orderkey AS id, NULL AS parent, o_orderdate AS trashed FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'page', l_orderkey * 10 + l_linenumber, l_orderkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' AND o_orderstatus <> 'F'""")
def trash_listing(spark, d):
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("trashed"))
    pages = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("trashed"))
    return library.trash(docs, pages).select("kind", "id", "parent", "trashed")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS documents, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS pages")
def trash_counts(spark, d):
    docs = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("papelera"))
    pages = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("papelera"))
    return library.trash_counts(docs, pages)


# Retention, names, labels


@query(f"SELECT event_id, greatest(0, CAST(ceil(((epoch_us(ts) // 1000) + 2592000000 - {NOW_MS}) / 86400000.0) AS BIGINT)) AS days FROM events")
def trash_days_left(spark, d):
    return table(spark, d, "events").select("event_id", dates.days_left(ms(F.col("ts")), F.lit(NOW_MS)).alias("days"))


@query(f"SELECT count(*) AS purged FROM events WHERE (epoch_us(ts) // 1000) < {NOW_MS} - 2592000000")
def ttl_purge_count(spark, d):
    docs = table(spark, d, "events").select(F.col("event_id").alias("id"), ms(F.col("ts")).alias("papelera"))
    pages = spark.createDataFrame([], "id long, doc_id long, papelera struct<cuando:bigint,lugar:int>")
    return commands.purge_count(docs, pages, NOW_MS)


_REMINDER_SQL = f"""
WITH u AS (SELECT user_id, count(*) AS n, min((epoch_us(ts) // 1000)) AS created, max((epoch_us(ts) // 1000)) AS changed, max(CASE WHEN event_type = 'purchase' THEN (epoch_us(ts) // 1000) - 2592000000 END) AS last FROM events GROUP BY user_id),
r AS (SELECT user_id, CASE WHEN coalesce(last, 0) <> 0 THEN CASE WHEN changed > last AND {NOW_MS} - last >= 2592000000 THEN last END WHEN {NOW_MS} - created >= 604800000 THEN created END AS since, last FROM u)
SELECT user_id, coalesce(last, 0) = 0 AS never, CAST(floor(({NOW_MS} - since) / 86400000.0) AS BIGINT) AS days FROM r WHERE since IS NOT NULL
"""


@query(_REMINDER_SQL)
def backup_reminder(spark, d):
    t = ms(F.col("ts"))
    per = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min(t).alias("created"), F.max(t).alias("changed"), F.max(F.when(F.col("event_type") == "purchase", t - 30 * dates.DAY)).alias("last"))
    told = per.withColumn("r", dates.reminder(F.col("n"), F.col("created"), F.col("changed"), F.col("last"), F.lit(None).cast("long"), F.lit(NOW_MS)))
    return told.where("r IS NOT NULL").select("user_id", "r.never", "r.days")


@query("SELECT user_id, CASE WHEN count(*) < 5 THEN 0 ELSE CAST(least(30000 * pow(2, least(count(*), 40) - 5), 900000) AS BIGINT) END AS wait FROM events WHERE event_type = 'error' GROUP BY user_id")
def backoff_wait(spark, d):
    failed = table(spark, d, "events").where("event_type = 'error'")
    return failed.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", dates.backoff(F.least(F.col("n"), F.lit(40))).alias("wait"))


_SIZE_SQL = """
WITH s AS (SELECT doc_id, n_chars * n_chars AS b FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN CAST(CAST(floor(b / 1024.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB'
ELSE CAST(CAST(floor(b / 104857.6 + 0.5) AS BIGINT) // 10 AS VARCHAR) || ',' || CAST(CAST(floor(b / 104857.6 + 0.5) AS BIGINT) % 10 AS VARCHAR) || ' MB' END AS size FROM s
"""


@query(_SIZE_SQL)
def human_size(spark, d):
    return table(spark, d, "documents").select("doc_id", text.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"))


@query(r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_replace(url, '[\\/:*?"<>|]+', ' ', 'g'), '\s+', ' ', 'g')), ''), 'Escaneo') || '.pdf' AS file FROM pages""")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", text.file_name(F.col("url"), "pdf").alias("file"))


@query("SELECT conv_id, CASE WHEN count(*) = 1 THEN '1 página' ELSE CAST(count(*) AS VARCHAR) || ' páginas' END AS label FROM conversations GROUP BY conv_id")
def plural_label(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", text.pages_label(F.col("n")).alias("label"))


_SUFFIX_SQL = """
WITH names AS (SELECT DISTINCT source, CASE WHEN doc_id % 7 = 0 THEN lang ELSE lang || ' (' || CAST(doc_id % 7 + 1 AS VARCHAR) || ')' END AS name FROM documents WHERE source < 's' OR doc_id % 7 <> 3),
bases AS (SELECT DISTINCT source, lang FROM documents),
wanted AS (SELECT source, lang, n, CASE WHEN n = 1 THEN lang ELSE lang || ' (' || CAST(n AS VARCHAR) || ')' END AS name FROM bases, generate_series(1, (SELECT count(*) + 1 FROM documents)) g(n))
SELECT w.source, w.lang, arg_min(w.name, w.n) AS name FROM wanted w LEFT JOIN names t ON w.source = t.source AND w.name = t.name WHERE t.name IS NULL GROUP BY w.source, w.lang
"""


@query(_SUFFIX_SQL)
def unique_name_suffix(spark, d):
    docs = table(spark, d, "documents")
    n = F.col("doc_id") % 7
    taken = docs.where((F.col("source") < "s") | (n != 3)).select("source", F.when(n == 0, F.col("lang")).otherwise(F.concat("lang", F.lit(" ("), (n + 1).cast("string"), F.lit(")"))).alias("name"))
    return library.free_name(docs.select("source", "lang").distinct(), taken, ["source"], "lang")


# Text


@query(r"SELECT doc_id, regexp_replace(text, '(\p{L})[-‐]\n(\p{Ll})', '\1\2', 'g') AS joined FROM documents")
def dehyphenate_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.join_hyphens(F.col("text")).alias("joined"))


@query(r"SELECT doc_id, len(string_split_regex(text, '\n\s*\n')) AS blocks FROM documents")
def paragraph_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.blocks(F.col("text"))).cast("long").alias("blocks"))


_WHITE = r"[\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_ENTRY = r"(\(?[0-9]{1,3}[.)°º-]|\(?[a-zñA-ZÑ][.)]|[•·▪◦\-–—])[\t\x0b\f\r ]"
#: Blocks, then lines, put together by a window: the number of entries and blocks so far names a line's paragraph.
_PARAGRAPHS_SQL = rf"""
WITH b AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\n[\t-\r ]*\n')) AS block, generate_subscripts(string_split_regex(coalesce(text, ''), '\n[\t-\r ]*\n'), 1) AS k FROM documents),
l AS (SELECT doc_id, k, unnest(string_split(block, chr(10))) AS line, generate_subscripts(string_split(block, chr(10)), 1) AS i FROM b),
t AS (SELECT doc_id, k, i, regexp_replace(line, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS line FROM l),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) = 1 OR regexp_matches(line, '^{_ENTRY}') AS fresh, lag(line) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM t WHERE line <> ''),
p AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS n, NOT fresh AND regexp_matches(before, '\pL[-‐]$') AND regexp_matches(line, '^\p{{Ll}}') AS cut, lead(line) OVER (PARTITION BY doc_id ORDER BY k, i) AS nxt FROM s),
q AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY doc_id ORDER BY k, i), false) AS loses FROM p)
SELECT doc_id, CAST(n AS INTEGER) AS n, string_agg(CASE WHEN fresh OR cut THEN '' ELSE ' ' END || CASE WHEN loses THEN left(line, length(line) - 1) ELSE line END, '' ORDER BY k, i) AS paragraph FROM q GROUP BY doc_id, n
"""


@query(_PARAGRAPHS_SQL)
def paragraphs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.paragraphs(F.col("text")))).select("doc_id", F.col("pos").alias("n"), F.col("col").alias("paragraph"))


#: Boundaries from one expression; cuts of long pieces and joins of short ones each by recursion over a document's pieces.
_SENTENCES_SQL = r"""
WITH RECURSIVE a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[.!?;:\n]*[^.!?;:\n]+(?:[.!?;:]+|\n+|$)')) AS s, generate_subscripts(regexp_extract_all(text, '[.!?;:\n]*[^.!?;:\n]+(?:[.!?;:]+|\n+|$)'), 1) AS k FROM documents),
b AS (SELECT *, length(regexp_extract(s, '^[.!?;:\n]*')) AS skip, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM a),
c AS (SELECT doc_id, k, place + skip AS st, place + length(s) AS en, substr(s, skip + 1) AS s FROM b WHERE regexp_matches(substr(s, skip + 1), '[^\s\x0b]')),
cut AS (SELECT doc_id, k, 0 AS j, st, en, s FROM c UNION ALL
SELECT doc_id, k, j + 1, st + n, en, substr(s, CAST(n AS BIGINT) + 1) FROM (SELECT *, CASE WHEN position(' ' IN reverse(substr(s, 1, 220))) BETWEEN 1 AND 109 THEN 221 - position(' ' IN reverse(substr(s, 1, 220))) ELSE 220 END AS n FROM cut WHERE en - st > 220)),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS n, st, coalesce(lead(st) OVER (PARTITION BY doc_id, k ORDER BY j), en) AS en, lead(st) OVER (PARTITION BY doc_id, k ORDER BY j) IS NULL AS last FROM cut),
m AS (SELECT doc_id, n, st, en, 1 AS g FROM p WHERE n = 1 UNION ALL
SELECT p.doc_id, p.n, CASE WHEN p.last AND m.en - m.st < 60 AND p.en - m.st <= 220 THEN m.st ELSE p.st END, p.en, CASE WHEN p.last AND m.en - m.st < 60 AND p.en - m.st <= 220 THEN m.g ELSE m.g + 1 END FROM m JOIN p ON p.doc_id = m.doc_id AND p.n = m.n + 1),
f AS (SELECT doc_id, min(st) AS st, max(en) AS en FROM m GROUP BY doc_id, g)
SELECT f.doc_id, CAST(st AS INTEGER) AS start, CAST(en AS INTEGER) AS "end", trim(regexp_replace(substr(text, CAST(st AS BIGINT) + 1, CAST(en - st AS BIGINT)), '[\s\x0b—–]+', ' ', 'g')) AS text FROM f JOIN documents d ON f.doc_id = d.doc_id
WHERE trim(regexp_replace(substr(text, CAST(st AS BIGINT) + 1, CAST(en - st AS BIGINT)), '[\s\x0b—–]+', ' ', 'g')) <> ''
"""


@query(_SENTENCES_SQL)
def sentence_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(text.sentences()("text")).alias("s")).select("doc_id", "s.start", "s.end", "s.text")


@query("SELECT conv_id, string_agg('— Página ' || CAST(turn + 1 AS VARCHAR) || ' —' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def page_header_concat(spark, d):
    pages = table(spark, d, "conversations").select("conv_id", F.struct((F.col("turn") + 1).alias("n"), "text").alias("p"))
    return pages.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p")).select("conv_id", text.with_page_headers(F.col("p")).alias("body"))


_RANGES_SQL = """
WITH n AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS n FROM lineitem WHERE l_returnflag <> 'R'),
g AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey ORDER BY n) AS k FROM n),
r AS (SELECT l_orderkey, min(n) AS a, max(n) AS b FROM g GROUP BY l_orderkey, k)
SELECT l_orderkey, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '–' || CAST(b AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM r GROUP BY l_orderkey
"""


@query(_RANGES_SQL)
def page_ranges(spark, d):
    return table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(arrays.ranges(F.collect_list("l_linenumber")).alias("pages"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN 'enlace' ELSE 'texto' END AS kind, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN regexp_matches(url, '(?i)^https:') END AS safe FROM pages")
def classify_code(spark, d):
    c = codes.classify(F.col("url"))
    return table(spark, d, "pages").select("page_id", c.alias("c")).select("page_id", F.col("c.tipo").alias("kind"), F.col("c.seguro").alias("safe"))


#: Codes of all kinds, written from the customers' names; the SQL states what each must say without reading it.
_CODE = """CASE c_custkey % 8 WHEN 0 THEN 'WIFI:T:wpa;S:' || c_name || {wifi} || CAST(c_custkey AS {text}) || ';H:true;;' WHEN 1 THEN 'mailto:a' || CAST(c_custkey AS {text}) || '@e.com?subject=Hi'
WHEN 2 THEN 'MATMSG:TO:b@e.com;SUB:' || c_name || ';;' WHEN 3 THEN 'tel:+504' || CAST(c_custkey AS {text})
WHEN 4 THEN 'BEGIN:VCARD' || {line} || 'VERSION:3.0' || {line} || 'FN:' || c_name || {line} || 'TEL;TYPE=cell:+1' || CAST(c_custkey AS {text}) || {line} || 'EMAIL:c@e.com' || {line} || 'END:VCARD'
WHEN 5 THEN 'MECARD:N:Paz,' || c_name || ';TEL:+2' || CAST(c_custkey AS {text}) || ';EMAIL:d@e.com;;' WHEN 6 THEN 'www.Site' || CAST(c_custkey AS {text}) || '.com/x?y=1' ELSE '  ' || c_name || ' ' END"""


@query(r"""SELECT c_custkey, k[1] AS kind, nullif(k[2], '') AS url, nullif(k[3], '') AS host, nullif(k[4], '') AS network, nullif(k[5], '') AS secret, nullif(k[6], '') AS mail, nullif(k[7], '') AS phone, nullif(k[8], '') AS name FROM (
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN ['wifi', '', '', c_name, 'a;b' || c_custkey, '', '', ''] WHEN 1 THEN ['correo', 'mailto:a' || c_custkey || '@e.com?subject=Hi', '', '', '', 'a' || c_custkey || '@e.com', '', '']
WHEN 2 THEN ['correo', 'mailto:b@e.com', '', '', '', 'b@e.com', '', ''] WHEN 3 THEN ['telefono', 'tel:+504' || c_custkey, '', '', '', '', '+504' || c_custkey, '']
WHEN 4 THEN ['contacto', '', '', '', '', 'c@e.com', '+1' || c_custkey, c_name] WHEN 5 THEN ['contacto', '', '', '', '', 'd@e.com', '+2' || c_custkey, c_name || ' Paz']
WHEN 6 THEN ['enlace', 'https://www.Site' || c_custkey || '.com/x?y=1', 'site' || c_custkey || '.com', '', '', '', '', ''] ELSE ['texto', '', '', '', '', '', '', ''] END AS k FROM customer)""")
def code_fields(spark, d):
    written = F.expr(_CODE.format(text="STRING", line="chr(10)", wifi=r"';P:a\\\;b'"))
    c = codes.classify(written)
    names = {"tipo": "kind", "url": "url", "sitio": "host", "red": "network", "clave": "secret", "correo": "mail", "telefono": "phone", "nombre": "name"}
    return table(spark, d, "customer").select("c_custkey", c.alias("c")).select("c_custkey", *[F.col(f"c.{f}").alias(n) for f, n in names.items()])


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '(?i)^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages")
def link_host(spark, d):
    return table(spark, d, "pages").select("page_id", codes.host(F.col("url")).alias("host"))


@query("SELECT l_orderkey, l_linenumber, 'l3|' || l_returnflag || '|' || CAST(l_linenumber % 4 AS VARCHAR) || '|' || CASE WHEN l_linestatus = 'O' THEN 'true' ELSE 'false' END || '|true|' || CAST(l_partkey AS VARCHAR) || 'x' || CAST(l_suppkey AS VARCHAR) || '|[]' || CASE WHEN l_linenumber > 3 THEN '|luz' || CAST(l_linenumber AS VARCHAR) || ',0' ELSE '' END AS version FROM lineitem")
def version_key(spark, d):
    n = F.col("l_linenumber")
    key = text.version_key("l3", F.col("l_returnflag"), n % 4, F.col("l_linestatus") == "O", F.lit(None).cast("boolean"), F.col("l_partkey"), F.col("l_suppkey"), F.lit("[]"), F.when(n > 3, n), F.lit(0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", key.alias("version"))


@query(r"SELECT c_custkey, len(p) BETWEEN 4 AND 12 AND p SIMILAR TO '[0-9]+' AS valid FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_phone WHEN 1 THEN replace(c_phone, '-', '') WHEN 2 THEN right(c_phone, 4) ELSE right(c_phone, 3) || chr(10) END AS p FROM (SELECT c_custkey, '1' || CAST(c_custkey AS VARCHAR) || '-222-3333' AS c_phone FROM customer))")
def pin_format(spark, d):
    phone = F.concat(F.lit("1"), F.col("c_custkey").cast("string"), F.lit("-222-3333"))
    k = F.col("c_custkey") % 4
    pin = F.when(k == 0, phone).when(k == 1, F.replace(phone, F.lit("-"), F.lit(""))).when(k == 2, F.right(phone, F.lit(4))).otherwise(F.concat(F.right(phone, F.lit(3)), F.lit("\n")))
    return table(spark, d, "customer").select("c_custkey", codes.pin_format(pin).alias("valid"))


@query("SELECT l_orderkey, count(*) AS parts, count(DISTINCT l_returnflag) AS colours FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey")
def highlight_colours(spark, d):
    return highlights.colours(table(spark, d, "lineitem").where("l_linestatus = 'F'"), "l_orderkey", "l_returnflag")


@query("""WITH s AS (SELECT user_id, CASE WHEN round(value) - 50 > 0 THEN 1 ELSE -1 END AS sign, count(*) AS n, sum(abs(round(value) - 50)) AS strength FROM events WHERE round(value) <> 50 GROUP BY user_id, sign)
SELECT user_id, CAST(sign AS INTEGER) AS sign FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, strength DESC, sign DESC) = 1""")
def dominant_sign(spark, d):
    return library.dominant_sign(table(spark, d, "events").select("user_id", (F.round("value") - 50).alias("v")), "user_id", "v")


#: Pages of 1024 by 1024 pixels: an order line is a word, an order a stroke of three points and of one of two widths.
_DRAWN_SQL = """WITH w AS (SELECT l_orderkey // 200 AS page_id, l_orderkey AS line, l_linenumber AS word, l_partkey * 37 % 1000 + 12 AS cx, l_suppkey * 91 % 1000 + 12 AS cy, 6 + l_quantity % 5 * 4 AS half FROM lineitem),
o AS (SELECT o_orderkey // 200 AS page_id, o_orderkey AS stroke, CASE WHEN o_custkey % 3 = 0 THEN 0.031 ELSE 0.0137 END * 512 AS g, [o_custkey * 53 % 1024, o_orderkey * 29 % 1024, (o_custkey * 53 + 200) % 1024, (o_orderkey * 29 + o_custkey % 40) % 1024, o_custkey * 11 % 1024, o_orderkey * 17 % 1024] AS p FROM orders),
leg AS (SELECT page_id, stroke, g, p[1] AS ax, p[2] AS ay, p[3] - p[1] AS dx, p[4] - p[2] AS dy FROM o UNION ALL SELECT page_id, stroke, g, p[3], p[4], p[5] - p[3], p[6] - p[4] FROM o),
m AS (SELECT w.page_id, line, word, cx, cy, half, stroke, g, ax, ay, dx, dy, CASE WHEN dx = 0 AND dy = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, CAST((cx - ax) * dx + (cy - ay) * dy AS DOUBLE) / (dx * dx + dy * dy))) END AS t FROM w JOIN leg USING (page_id)) """


def _drawn(spark, d) -> tuple[DataFrame, DataFrame]:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    cx, cy = F.col("l_partkey") * 37 % 1000 + 12, F.col("l_suppkey") * 91 % 1000 + 12
    half = 6 + F.col("l_quantity") % 5 * 4
    words = lines.select(F.expr("l_orderkey DIV 200").alias("page_id"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("word"), F.col("l_comment" if "l_comment" in lines.columns else "l_returnflag").alias("t"), (cx - 10).alias("x0"), (cy - half).alias("y0"), (cx + 10).alias("x1"), (cy + half).alias("y1"))
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    points = [c * 53 % 1024, k * 29 % 1024, (c * 53 + 200) % 1024, (k * 29 + c % 40) % 1024, c * 11 % 1024, k * 17 % 1024]
    strokes = orders.select(F.expr("o_orderkey DIV 200").alias("page_id"), k.alias("stroke"), F.col("o_orderpriority").alias("color"), F.when(c % 3 == 0, 0.031).otherwise(0.0137).alias("thickness"), F.array(*[p / 1024 for p in points]).alias("points"), F.lit(1024.0).alias("width"), F.lit(1024.0).alias("height"))
    return strokes, words


@query(_DRAWN_SQL + "SELECT page_id, line, word, min(stroke) AS stroke FROM m WHERE sqrt(pow(cx - ax - t * dx, 2) + pow(cy - ay - t * dy, 2)) <= greatest(g, 0.9 * half) GROUP BY page_id, line, word")
def highlight_claims(spark, d):
    """Each word with the first stroke that touches it, by a join of squares; the SQL measures every stroke against every word of a page."""
    strokes, words = _drawn(spark, d)
    return highlights.touching(strokes, words).select("page_id", "line", "word", "stroke")


@query(_DRAWN_SQL + "SELECT line * 10 + word AS point_id, max(stroke) AS mark FROM m WHERE CASE WHEN stroke % 4 = 0 THEN cx BETWEEN ax - 2 AND ax + 42 AND cy BETWEEN ay - 2 AND ay + 22 AND (page_id, stroke, ax, ay) IN (SELECT page_id, stroke, p[1], p[2] FROM o) ELSE sqrt(pow(cx - ax - t * dx, 2) + pow(cy - ay - t * dy, 2)) <= g + 2 END GROUP BY line, word")
def mark_hits(spark, d):
    """The topmost mark under each point; every fourth mark is a note's box."""
    strokes, words = _drawn(spark, d)
    note, at = F.col("stroke") % 4 == 0, lambda k: F.get("points", F.lit(k)) * 1024
    marks = strokes.select("page_id", F.col("stroke").alias("mark"), F.when(note, "nota").otherwise("resaltador").alias("kind"), F.struct(at(0).alias("x"), at(1).alias("y"), F.lit(40.0).alias("w"), F.lit(20.0).alias("h")).alias("box"), "thickness", "points", "width", "height")
    points = words.select("page_id", (F.col("line") * 10 + F.col("word")).alias("point_id"), ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return highlights.mark_at(marks, points, margin=2.0)


_HUE_SQL = """
WITH c AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_orderkey % 256 AS INTEGER) AS b FROM lineitem),
m AS (SELECT *, greatest(r, g, b) AS hi, greatest(r, g, b) - least(r, g, b) AS d FROM c),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = r THEN CASE WHEN g >= b THEN 60.0 * (g - b) / d ELSE 360 + 60.0 * (g - b) / d END WHEN hi = g THEN 120 + 60.0 * (b - r) / d ELSE 240 + 60.0 * (r - g) / d END AS hue FROM m)
SELECT l_orderkey, l_linenumber, r, g, b, round(hue, 6) AS hue, round(CASE WHEN d = 0 THEN 0 ELSE CAST(d AS DOUBLE) / hi END, 6) AS saturation,
round(255 * (0.06 + 0.68 * CASE WHEN hue < 60 OR hue >= 300 THEN 1 WHEN hue < 120 THEN 2 - hue / 60 WHEN hue < 240 THEN 0 ELSE hue / 60 - 4 END), 6) AS ink_red FROM h
"""


@query(_HUE_SQL)
def hue_and_ink(spark, d):
    byte = lambda c: (F.col(c) % 256).cast("int")
    c = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", byte("l_partkey").alias("r"), byte("l_suppkey").alias("g"), byte("l_orderkey").alias("b"))
    h = c.withColumn("h", arrays.hue(F.col("r"), F.col("g"), F.col("b")))
    return h.select("l_orderkey", "l_linenumber", "r", "g", "b", F.round("h.hue", 6).alias("hue"), F.round("h.saturation", 6).alias("saturation"), F.round(arrays.ink_of_hue(F.col("h.hue"))["r"], 6).alias("ink_red"))


# Ordered arrays and commands


def _lists(spark, d) -> DataFrame:
    pages = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("pages"))
    return pages.select("conv_id", "pages")


_LISTS = "WITH l AS (SELECT conv_id, list(turn ORDER BY turn) AS pages FROM conversations GROUP BY conv_id) "


@query(_LISTS + "SELECT conv_id, CAST(list_filter(pages, lambda x: NOT list_contains([1, 3], x)) AS VARCHAR) AS pages FROM l")
def array_remove(spark, d):
    return _lists(spark, d).select("conv_id", _shown(arrays.without(F.col("pages"), F.array(F.lit(1).cast("long"), F.lit(3).cast("long")))))


def _shown(items) -> F.Column:
    return F.concat(F.lit("["), F.array_join(items.cast("array<string>"), ", "), F.lit("]")).alias("pages")


@query(_LISTS + "SELECT conv_id, CAST(list_concat(list_concat(pages[:least(3, len(pages))], [99]), pages[least(3, len(pages)) + 1:]) AS VARCHAR) AS pages FROM l")
def array_insert_clamped(spark, d):
    return _lists(spark, d).select("conv_id", _shown(arrays.insert_at(F.col("pages"), F.lit(99).cast("long"), F.lit(3))))


@query(_LISTS + "SELECT conv_id, CAST(list_concat(list_filter([2, 0, 7], lambda x: list_contains(pages, x)), list_filter(pages, lambda x: NOT list_contains([2, 0, 7], x))) AS VARCHAR) AS pages FROM l")
def array_move(spark, d):
    order = F.array(*[F.lit(x).cast("long") for x in (2, 0, 7)])
    return _lists(spark, d).select("conv_id", _shown(arrays.reorder(F.col("pages"), order)))


@query(_LISTS + "SELECT conv_id AS id, CAST(list_transform(CASE WHEN conv_id = 3 THEN pages[:1] ELSE pages END, lambda x: conv_id * 1000 + x) AS VARCHAR) AS pages FROM l UNION ALL SELECT -1, CAST(list_transform(pages[2:], lambda x: 3000 + x) AS VARCHAR) FROM l WHERE conv_id = 3")
def split_at(spark, d):
    """The third conversation from its second page on becomes another document."""
    docs, pages = _store(spark, d)
    new = docs.limit(0).select("id").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"))).withColumns({"modificado": F.lit(0).cast("long"), "papelera": F.lit(None).cast("long")})
    return commands.split_document(docs, pages, 3, 2, new, NOW_MS)[0].select("id", _shown(F.col("paginas")))


@query(_LISTS + "SELECT a.conv_id AS id, CAST(CASE WHEN a.conv_id = 4 THEN list_concat(list_transform(a.pages, lambda x: 4000 + x), list_transform(b.pages, lambda x: 6000 + x)) ELSE list_transform(a.pages, lambda x: a.conv_id * 1000 + x) END AS VARCHAR) AS pages FROM l a, l b WHERE b.conv_id = 6 AND a.conv_id <> 6")
def merge_documents(spark, d):
    docs, pages = _store(spark, d)
    return commands.merge_documents(docs, pages, 4, 6, NOW_MS)[0].select("id", _shown(F.col("paginas")))


def _store(spark, d):
    pages = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("doc_id"), "text", F.lit(None).cast("struct<cuando:bigint,lugar:int>").alias("papelera"))
    docs = pages.groupBy(F.col("doc_id").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("paginas")).withColumn("modificado", F.col("id") * 1000)
    return docs.withColumn("papelera", F.when(F.col("id") % 5 == 0, F.lit(NOW_MS - 31 * dates.DAY) + F.col("id") * dates.DAY % (40 * dates.DAY))), pages


@query(f"SELECT conv_id * 1000 + turn AS id, {NOW_MS} AS cuando, CAST(turn AS INTEGER) AS lugar FROM conversations WHERE conv_id = 7 AND turn IN (0, 2)")
def soft_delete_pages(spark, d):
    docs, pages = _store(spark, d)
    _, pages = commands.trash_pages(docs, pages, 7, [7000, 7002, 8000], NOW_MS)
    return pages.where("papelera IS NOT NULL").select("id", F.col("papelera.cuando").alias("cuando"), F.col("papelera.lugar").alias("lugar"))


@query(_LISTS + "SELECT conv_id AS id, CAST(list_transform(pages, lambda x: conv_id * 1000 + x) AS VARCHAR) AS pages FROM l")
def restore_pages(spark, d):
    docs, pages = _store(spark, d)
    docs, pages = commands.trash_pages(docs, pages, 7, [7000, 7002], NOW_MS)
    for page in (7000, 7002):
        docs, pages = commands.restore_page(docs, pages, page)
    return docs.select("id", _shown(F.col("paginas")))


@query(f"SELECT DISTINCT conv_id AS id, CASE WHEN conv_id = 5 THEN {NOW_MS} ELSE conv_id * 1000 END AS changed, conv_id % 5 = 0 AND conv_id <> 5 AS trashed FROM conversations")
def restore_document(spark, d):
    docs, _ = _store(spark, d)
    return commands.restore_document(docs, 5, NOW_MS).select("id", F.col("modificado").alias("changed"), F.col("papelera").isNotNull().alias("trashed"))


@query(f"SELECT DISTINCT conv_id AS id FROM conversations WHERE NOT (conv_id % 5 = 0 AND {NOW_MS} - 2678400000 + (conv_id * 86400000) % 3456000000 < {NOW_MS} - 2592000000)")
def purge_expired(spark, d):
    docs, pages = _store(spark, d)
    return commands.purge(docs, pages, NOW_MS)[0].select("id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'U' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -1, 'N'")
def upsert_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    new = orders.where("o_orderkey % 10 = 0").withColumn("status", F.lit("U")).unionByName(spark.sql("SELECT CAST(-1 AS BIGINT) AS o_orderkey, 'N' AS status"))
    return commands.upsert(orders, new, "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)")
def cascade_delete(spark, d):
    gone = table(spark, d, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"))
    docs, pages = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    return commands.delete_documents(docs, pages, gone)[1].select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@query("WITH l AS (SELECT user_id, event_type, max(ts) AS ts FROM events GROUP BY user_id, event_type) SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type) AS n FROM l QUALIFY n <= 3")
def top_k_recent_distinct(spark, d):
    return library.recent_distinct(table(spark, d, "events"), "user_id", "event_type", "ts", 3).select("user_id", "event_type", F.col("n").cast("long").alias("n"))


@query("SELECT n_name AS folder, row_number() OVER (ORDER BY lower(n_name), n_name) AS n FROM nation")
def collation_sort(spark, d):
    folders = table(spark, d, "nation").select(F.col("n_name").alias("nombre"), F.col("n_name").alias("id"))
    return library.folders_numbered(folders).select(F.col("nombre").alias("folder"), "n")


_NEAREST_SQL = """
WITH e AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS twin, a.n - b.n AS back FROM e a JOIN e b ON a.label = b.label AND a.n - b.n BETWEEN 1 AND 5 WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3)
SELECT vec_id, arg_min(twin, back) AS twin FROM p GROUP BY vec_id
"""


@query(_NEAREST_SQL)
def nearest_previous_duplicate(spark, d):
    e = library.numbered(table(spark, d, "embeddings"), "label", "vec_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    alike = lambda x, y: dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)) >= 0.3
    return library.nearest_previous(e, "label", "n", "vec_id", "embedding", alike, 5).select("vec_id", "twin")


_PERCENTILE_SQL = """
WITH s AS (SELECT lang, list(n_chars ORDER BY n_chars) AS a FROM documents GROUP BY lang)
SELECT lang, a[CAST(floor(len(a) * 0.9) AS BIGINT) + 1] AS p90, a[len(a) // 2 + 1] AS middle FROM s
"""


@query(_PERCENTILE_SQL)
def exact_percentile(spark, d):
    return library.value_percentiles(table(spark, d, "documents"), "lang", "n_chars", {"p90": 0.9, "middle": 0.5})


@query("""WITH s AS (SELECT l_returnflag, list(l_extendedprice ORDER BY l_extendedprice) AS a FROM lineitem GROUP BY l_returnflag)
SELECT l_returnflag, a[1] AS low, a[len(a) // 4 + 1] AS quarter, a[len(a) // 2 + 1] AS middle, a[CAST(floor(len(a) * 0.99) AS BIGINT) + 1] AS p99, a[len(a)] AS top FROM s""")
def price_percentiles(spark, d):
    """Order statistics of three large groups."""
    return library.value_percentiles(table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", {"low": 0.0, "quarter": 0.25, "middle": 0.5, "p99": 0.99, "top": 1.0})


_HIST_SQL = """
WITH h AS (SELECT n_chars // 100 AS bin, count(*) AS n FROM documents GROUP BY 1),
c AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER () AS total FROM h)
SELECT CAST(min(bin) FILTER (WHERE upto >= 0.5 * total) AS BIGINT) AS p50, CAST(min(bin) FILTER (WHERE upto >= 0.95 * total) AS BIGINT) AS p95 FROM c
"""


@query(_HIST_SQL)
def histogram_percentile(spark, d):
    bins = table(spark, d, "documents").groupBy(F.floor(F.col("n_chars") / 100).alias("bin")).agg(F.count("*").alias("n"))
    return library.bin_percentiles(bins, {"p50": 0.5, "p95": 0.95})


_OTSU_SQL = """
WITH h AS (SELECT CAST(floor(l_quantity) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT bin, sum(n) OVER (ORDER BY bin) AS w0, sum(n * bin) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS w, sum(n * bin) OVER () AS s FROM h),
v AS (SELECT bin, CASE WHEN w0 < w THEN CAST(w0 AS DOUBLE) * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END AS v FROM c)
SELECT bin AS threshold FROM v ORDER BY v DESC, bin LIMIT 1
"""


@query(_OTSU_SQL)
def otsu_threshold(spark, d):
    bins = table(spark, d, "lineitem").groupBy(F.floor("l_quantity").cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return library.otsu(bins)


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS top, min(value) OVER w AS low FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def sliding_mean(spark, d):
    means = library.sliding(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", 2)
    return means.select("event_id", F.round("mean", 6).alias("mean"), "top", "low")


@query("SELECT DISTINCT v, CAST(greatest(0, least(255, floor(255 * ((pow(v / 255.0, pow(2, -0.4)) - 0.5) * pow(2, 0.2) + 0.5) + 0.5))) AS INTEGER) AS lit FROM (SELECT l_partkey % 256 AS v FROM lineitem)")
def luma_lut(spark, d):
    """The light curve of each byte that the lines have."""
    return table(spark, d, "lineitem").select((F.col("l_partkey") % 256).alias("v")).distinct().select("v", arrays.light_curve(F.col("v"), 20, 10).alias("lit"))


_CRC_SQL = """
WITH t AS (SELECT list(list_reduce(list_prepend(CAST(i AS UBIGINT), list_transform(range(8), lambda x: CAST(x AS UBIGINT))), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS hx FROM documents),
b AS (SELECT doc_id, list_transform(hx, lambda x: CAST('0x' || x AS UBIGINT)) AS bytes FROM h)
SELECT doc_id, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), bytes), lambda c, x: xor(tab[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS crc FROM b, t
"""


@query(_CRC_SQL)
def crc32_text(spark, d):
    return table(spark, d, "documents").select("doc_id", files.crc32(F.col("text").cast("binary")).alias("crc"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g) SELECT user_id, CAST(run AS BIGINT) AS run, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, run""")
def runs_with_tolerance(spark, d):
    return library.runs(table(spark, d, "events"), "user_id", "ts", F.expr("INTERVAL 6 HOURS")).select("user_id", "run", "first", "last", "n")


_CODES_SQL = """
WITH RECURSIVE e AS (SELECT user_id, event_type AS code, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
s AS (SELECT user_id, n, code, ms, true AS told, code AS last, ms AS seen FROM e WHERE n = 1
UNION ALL SELECT e.user_id, e.n, e.code, e.ms, NOT (e.code = s.last AND e.ms - s.seen < 3000), e.code, CASE WHEN e.code = s.last AND e.ms - s.seen < 3000 THEN s.seen ELSE e.ms END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
SELECT CAST(user_id AS VARCHAR) AS camera, code, ms AS "at" FROM s WHERE told
"""


@query(_CODES_SQL)
def code_dedup_3s(spark, d):
    from ..streaming import capture

    scans = table(spark, d, "events").select(F.col("user_id").cast("string").alias("camera"), F.col("event_type").alias("code"), ms(F.col("ts")).alias("at"), "event_id")
    return capture.accepted_codes_batch(scans, order=("at", "event_id"))


_STILL_SQL = """
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS shot, epoch_us(ts) // 3600000000 AS "at", max(value) AS motion FROM events GROUP BY 1, 2), p AS (SELECT shot, min("at") AS pressed FROM f GROUP BY shot),
m AS (SELECT f.*, p.pressed, motion <= 60 * (1 + (f."at" - p.pressed) / 500.0) AS still FROM f JOIN p USING (shot) WHERE f."at" - p.pressed < 500),
g AS (SELECT a.shot, min(a."at") AS done FROM m a JOIN m b ON a.shot = b.shot AND b."at" <= a."at" - 5 WHERE a.still AND b.still AND NOT EXISTS (SELECT 1 FROM m c WHERE c.shot = a.shot AND NOT c.still AND c."at" BETWEEN b."at" AND a."at") GROUP BY a.shot)
SELECT shot, pressed, coalesce(done, pressed + 500) AS taken FROM p LEFT JOIN g USING (shot)
"""


@query(_STILL_SQL)
def wait_for_stillness(spark, d):
    """Frames of hours rather than milliseconds: still for five of them, at most five hundred."""
    from ..streaming import capture

    f = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("shot"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).alias("at")).agg(F.max("value").alias("motion"))
    f = f.withColumn("pressed", F.min("at").over(Window.partitionBy("shot")))
    return capture.stillness(f, 60, 5, 500)


@query("SELECT max((epoch_us(ts) // 1000)) AS changed, min((epoch_us(ts) // 1000)) AS created, count(*) AS documents FROM events")
def library_span(spark, d):
    return library.span(table(spark, d, "events"), ms(F.col("ts")))


@query("SELECT p_partkey, replace(replace(replace(p_name || ' <' || p_brand || '> & co', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM part")
def xml_text(spark, d):
    name = F.concat("p_name", F.lit(" <"), "p_brand", F.lit("> & co"))
    return table(spark, d, "part").select("p_partkey", text.xml_escape(name).alias("xml"))


@query("SELECT conv_id, turn, CAST(turn // 4 AS BIGINT) AS sheet, CAST(turn % 4 AS BIGINT) AS cell FROM conversations")
def sheets_of_four(spark, d):
    return library.sheets(table(spark, d, "conversations"), "turn", 4).select("conv_id", "turn", "sheet", "cell")
