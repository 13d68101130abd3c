"""Commands on the store as functions from snapshots to snapshots.

docs: id, paginas (ordered array), modificado, papelera (null or when it was trashed); pages: id, doc_id, papelera
(null or struct(cuando, lugar)), and whatever else rows hold. A command whose row is missing changes nothing. The current time is a
parameter. Both frames go out together; write_snapshot keeps that so on disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays, dates

Store = tuple[DataFrame, DataFrame]
TRASHED = "struct<cuando:bigint,lugar:int>"


def _ids(docs: DataFrame, ids) -> F.Column:
    kind = docs.schema["id"].dataType
    return F.array(*[F.lit(i).cast(kind) for i in ids]) if ids else F.array().cast(f"array<{kind.simpleString()}>")


def _change(rows: DataFrame, row_id, **values) -> DataFrame:
    here = F.col("id") == F.lit(row_id)
    return rows.withColumns({c: F.when(here, v).otherwise(F.col(c)) for c, v in values.items()})


def _has(docs: DataFrame, doc_id) -> bool:
    return not docs.where(F.col("id") == F.lit(doc_id)).isEmpty()


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new over rows by key. Of rows of new that share a key the last stays, in the order of its partitions and of rows within them. A null key is a key like others."""
    gone = new.select(F.col(key).alias("_key")).distinct()
    # new is numbered and read once: a second reading may come in another order, so with other numbers.
    nth = new.withColumn("_nth", F.monotonically_increasing_id())
    chosen = nth.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*new.columns), "_nth").alias("_row")).select("_row.*")
    return rows.join(gone, F.col(key).eqNullSafe(F.col("_key")), "left_anti").unionByName(chosen, allowMissingColumns=True)


def _is(column: str, value) -> F.Column:
    """Whether a column has a value; a null is another value than any other."""
    return F.col(column).eqNullSafe(F.lit(value))


def _added(docs: DataFrame, pages: DataFrame, doc_id, page: DataFrame, now: int, place) -> Store:
    if not _has(docs, doc_id):
        raise KeyError(f"no document {doc_id}")
    page_id = page.select("id").first()[0]
    page = page.withColumn("doc_id", F.lit(doc_id).cast(pages.schema["doc_id"].dataType))
    item = F.lit(page_id).cast(pages.schema["id"].dataType)
    return _change(docs, doc_id, paginas=place(F.col("paginas"), item), modificado=F.lit(now)), upsert(pages, page)


def append_page(docs: DataFrame, pages: DataFrame, doc_id, page: DataFrame, now: int) -> Store:
    return _added(docs, pages, doc_id, page, now, lambda items, p: F.array_append(items, p))


def insert_page_after(docs: DataFrame, pages: DataFrame, doc_id, page: DataFrame, anchor, now: int) -> Store:
    return _added(docs, pages, doc_id, page, now, lambda items, p: arrays.insert_after(items, p, F.lit(anchor).cast(pages.schema["id"].dataType)))


def insert_page_at(docs: DataFrame, pages: DataFrame, doc_id, page: DataFrame, index: int, now: int) -> Store:
    return _added(docs, pages, doc_id, page, now, lambda items, p: arrays.insert_at(items, p, F.lit(index)))


def replace_page(pages: DataFrame, page: DataFrame) -> DataFrame:
    """page in the place of the one with its id; the document and the time of creation stay."""
    old = pages.select("id", F.col("doc_id").alias("_doc"), F.col("creada").alias("_made"))
    new = page.join(old, "id").withColumn("doc_id", F.col("_doc")).withColumn("creada", F.coalesce("_made", "creada")).drop("_doc", "_made")
    return upsert(pages, new)


def replace_document(docs: DataFrame, pages: DataFrame, doc: DataFrame, new_pages: DataFrame) -> Store:
    gone = doc.select(F.col("id").alias("doc_id"))
    return upsert(docs, doc), pages.join(gone, "doc_id", "left_anti").unionByName(new_pages, allowMissingColumns=True)


def delete_pages(docs: DataFrame, pages: DataFrame, doc_id, ids: list, now: int) -> Store:
    items = _ids(pages, ids)
    return _change(docs, doc_id, paginas=arrays.without(F.col("paginas"), items), modificado=F.lit(now)), pages.where(~F.coalesce(F.array_contains(items, F.col("id")), F.lit(False)))


def delete_document(docs: DataFrame, pages: DataFrame, doc_id) -> Store:
    """The document and all pages of it, trashed ones included."""
    return docs.where(~_is("id", doc_id)), pages.where(~_is("doc_id", doc_id))


def delete_documents(docs: DataFrame, pages: DataFrame, gone: DataFrame) -> Store:
    """delete_document for each id in gone (id)."""
    ids = gone.select("id").distinct()
    return docs.join(ids, "id", "left_anti"), pages.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_anti")


def delete_database(*tables: DataFrame) -> tuple[DataFrame, ...]:
    """Every table without its rows."""
    return tuple(t.where(F.lit(False)) for t in tables)


def delete_folder(folders: DataFrame, docs: DataFrame, folder_id) -> Store:
    """Its documents stay, without a folder."""
    return folders.where(~_is("id", folder_id)), docs.withColumn("carpeta_id", F.when(F.col("carpeta_id") == F.lit(folder_id), None).otherwise(F.col("carpeta_id")))


def move_pages(docs: DataFrame, pages: DataFrame, source, target, ids: list, now: int) -> Store:
    """Pages of source to the end of target, in source's order."""
    items = docs.where(F.col("id") == F.lit(source)).select(arrays.only(F.col("paginas"), _ids(pages, ids)).alias("p")).first()
    if items is None or not _has(docs, target):
        raise KeyError(f"no document {source if items is None else target}")
    moved = _ids(pages, items.p)
    docs = _change(docs, source, paginas=arrays.without(F.col("paginas"), moved), modificado=F.lit(now))
    docs = _change(docs, target, paginas=F.concat("paginas", moved), modificado=F.lit(now))
    return docs, pages.withColumn("doc_id", F.when(F.array_contains(moved, F.col("id")), F.lit(target).cast(pages.schema["doc_id"].dataType)).otherwise(F.col("doc_id")))


def merge_documents(docs: DataFrame, pages: DataFrame, target, donor, now: int) -> Store:
    """All pages of donor to the end of target; donor goes, and with it pages of its that were trashed."""
    ids = docs.where(F.col("id") == F.lit(donor)).select("paginas").first()
    docs, pages = move_pages(docs, pages, donor, target, list(ids.paginas) if ids else [], now)
    return delete_document(docs, pages, donor)


def split_document(docs: DataFrame, pages: DataFrame, doc_id, n: int, new_doc: DataFrame, now: int) -> Store:
    """From its n-th page (from 1) on, a document becomes new_doc."""
    row = docs.where(F.col("id") == F.lit(doc_id)).select(arrays.suffix(F.col("paginas"), F.lit(n)).alias("p")).first()
    docs = docs.unionByName(new_doc.withColumn("paginas", F.array().cast(docs.schema["paginas"].dataType)), allowMissingColumns=True)
    return move_pages(docs, pages, doc_id, new_doc.select("id").first()[0], list(row.p) if row else [], now)


def reorder_pages(docs: DataFrame, doc_id, order: list, now: int) -> DataFrame:
    return _change(docs, doc_id, paginas=arrays.reorder(F.col("paginas"), _ids(docs, order).cast(docs.schema["paginas"].dataType)), modificado=F.lit(now))


def trash_document(docs: DataFrame, doc_id, now: int) -> DataFrame:
    """The time of change stays."""
    return _change(docs, doc_id, papelera=F.lit(now).cast("long"))


def restore_document(docs: DataFrame, doc_id, now: int) -> DataFrame:
    """Back, and on top of the list."""
    return _change(docs, doc_id, papelera=F.lit(None).cast("long"), modificado=F.lit(now).cast("long"))


def trash_pages(docs: DataFrame, pages: DataFrame, doc_id, ids: list, now: int) -> Store:
    """Listed pages of the document keep the place they had before any was taken; ids that it doesn't list are ignored."""
    items = _ids(pages, ids)
    place = docs.where(F.col("id") == F.lit(doc_id)).select(F.posexplode("paginas").alias("_at", "_page")).where(F.array_contains(items, F.col("_page")))
    place = place.groupBy("_page").agg(F.min("_at").alias("_at"))  # an id listed twice has its first place
    pages = pages.join(place, F.col("id") == F.col("_page"), "left")
    stamp = F.struct(F.lit(now).cast("long").alias("cuando"), F.col("_at").cast("int").alias("lugar"))
    pages = pages.withColumn("papelera", F.when(F.col("_page").isNotNull(), stamp).otherwise(F.col("papelera"))).drop("_page", "_at")
    return _change(docs, doc_id, paginas=arrays.without(F.col("paginas"), items), modificado=F.lit(now)), pages


def restore_page(docs: DataFrame, pages: DataFrame, page_id, now: int | None = None) -> Store:
    """Back at its old place, or at the end of what is shorter now; it stays trashed if its document is gone. With a time, that is when the document changed."""
    page = pages.where((F.col("id") == F.lit(page_id)) & F.col("papelera").isNotNull()).select("doc_id", "papelera.lugar").first()
    if page is None or not _has(docs, page.doc_id):
        return docs, pages
    item = F.lit(page_id).cast(pages.schema["id"].dataType)
    at = F.lit(page.lugar) if page.lugar is not None else F.size("paginas")
    back = F.when(F.array_contains("paginas", item), F.col("paginas")).otherwise(arrays.insert_at(F.col("paginas"), item, at))
    changed = {} if now is None else {"modificado": F.lit(now)}
    return _change(docs, page.doc_id, paginas=back, **changed), _change(pages, page_id, papelera=F.lit(None).cast(TRASHED))


def delete_trashed_page(pages: DataFrame, page_id) -> DataFrame:
    return pages.where(~_is("id", page_id) | F.col("papelera").isNull())


def _purged(docs: DataFrame, pages: DataFrame, now: int, everything: bool) -> Store:
    old = lambda t: t.isNotNull() & (F.lit(everything) | dates.expired(t, F.lit(now)))
    gone = docs.where(old(F.col("papelera"))).select("id")
    parents = docs.where("papelera IS NULL").select(F.col("id").alias("doc_id"))
    loose = pages.where(old(F.col("papelera.cuando"))).join(parents, "doc_id", "left_semi").select("id")
    return gone, loose


def purge(docs: DataFrame, pages: DataFrame, now: int, everything: bool = False) -> Store:
    """What was trashed over thirty days ago goes (or all of the trash): documents with their pages, and loose pages."""
    gone, loose = _purged(docs, pages, now, everything)
    kept = pages.join(gone.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").join(loose, "id", "left_anti")
    return docs.join(gone, "id", "left_anti"), kept


def purge_count(docs: DataFrame, pages: DataFrame, now: int, everything: bool = False) -> DataFrame:
    """How many documents and loose pages purge removes; pages that go with their document don't count."""
    gone, loose = _purged(docs, pages, now, everything)
    return gone.unionByName(loose).agg(F.count("*").alias("purged"))


#: What a page has when it doesn't say.
PAGE_DEFAULTS = {"rotacion": 0, "aplanar": True, "dedos": True, "brillo": 0, "contraste": 0}


def reprocess(pages: DataFrame, page_id, changes: dict) -> DataFrame:
    """changes over the row over the defaults. Read text goes, unless it came with a PDF and shape and size stay; a new rotation turns the marks (turn_marks)."""
    here = F.col("id") == F.lit(page_id)
    values = {c: F.when(here, F.coalesce(F.lit(changes.get(c)).cast(pages.schema[c].dataType), F.col(c), F.lit(PAGE_DEFAULTS.get(c)).cast(pages.schema[c].dataType))).otherwise(F.col(c)) for c in {*PAGE_DEFAULTS, *changes} if c in pages.columns}
    same_shape = not {"esquinas", "rotacion", "aplanar", "dedos"} & changes.keys()
    if "ocr" in pages.columns:
        keep = (F.col("ocr.idioma") == "pdf") & F.lit(same_shape)
        values["ocr"] = F.when(here & ~F.coalesce(keep, F.lit(False)), F.lit(None).cast(pages.schema["ocr"].dataType)).otherwise(F.col("ocr"))
    if "nitidez" in pages.columns and "modo" in pages.columns:
        values["nitidez"] = F.when(here & F.coalesce(F.col("modo").isin("cedula", "pdf", "portada"), F.lit(False)), None).otherwise(F.col("nitidez"))
    return pages.withColumns(values)


def save_marks(pages: DataFrame, page_id, marks) -> DataFrame:
    return _change(pages, page_id, marcas=marks)


def touch_document_of(docs: DataFrame, pages: DataFrame, page_id, now: int) -> DataFrame:
    """docs, of which the page's has now as its time of change: what goes with reprocess and save_marks. The page's row stays where it is."""
    of = pages.where(F.col("id") == F.lit(page_id)).select(F.col("doc_id").alias("_touched")).distinct()
    out = docs.join(F.broadcast(of), docs["id"] == F.col("_touched"), "left")  # one row
    return out.withColumn("modificado", F.when(F.col("_touched").isNotNull(), F.lit(now).cast(docs.schema["modificado"].dataType)).otherwise(F.col("modificado"))).select(*docs.columns)


def last_of_each(rows: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key: what a sequence of upserts leaves."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at)))).where("_n = 1").drop("_n")


def write_snapshot(root: str, name: str, **frames: DataFrame) -> str:
    """All frames under root/name, then a pointer to it: a reader sees the old snapshot or the new one, whole.

    Pointers are only ever added, each under a new number, and the highest that is finished counts; nothing that a reader may need is
    deleted or overwritten.
    """
    spark = next(iter(frames.values())).sparkSession
    for table, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")
    last = _pointer(spark, root)
    spark.createDataFrame([(name,)], "snapshot string").coalesce(1).write.mode("errorifexists").json(f"{root}/pointers/n={(last.n if last else 0) + 1}")
    return f"{root}/{name}"


def _pointer(spark, root: str):
    """The highest number and its snapshot; None before the first. Unfinished pointers have no rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/pointers")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("snapshot string, n long").json(f"{root}/pointers").orderBy(F.desc("n")).first()


def read_snapshot(spark, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_pointer(spark, root).snapshot}/{table}")


#: The tables of a store, by what commands need of them; rows may hold more.
TABLES = {
    "docs": "id string, nombre string, creado long, modificado long, carpeta_id string, paginas array<string>, papelera long",
    "pages": f"id string, doc_id string, creada long, papelera {TRASHED}",
    "folders": "id string, nombre string, creada long",
    "settings": "clave string, valor string",
}


def open_store(spark, root: str) -> dict[str, DataFrame]:
    """The tables of the current snapshot; those that it lacks are empty, with their declared columns, as is a store without a snapshot."""
    now = _pointer(spark, root)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(table: str) -> bool:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{now.snapshot}/{table}")
        return path.getFileSystem(conf).exists(path)

    return {t: read_snapshot(spark, root, t) if now and there(t) else spark.createDataFrame([], schema) for t, schema in TABLES.items()}


def append_changes(root: str, table: str, rows: DataFrame, gone: DataFrame | None = None) -> None:
    """Add upserts (and ids that go) to a table's log: an edit writes its own rows, not the table. Later batches count over earlier ones."""
    spark = rows.sparkSession
    path = f"{root}/{table}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
    batch = 1 + (spark.read.parquet(path).agg(F.max("_batch")).first()[0] or 0 if there else 0)
    out = rows.select(F.struct(*rows.columns).alias("row"), F.col("id").alias("_id"))
    if gone is not None:
        out = out.unionByName(gone.select(F.lit(None).cast(out.schema["row"].dataType).alias("row"), F.col("id").alias("_id")))
    out.withColumns({"_batch": F.lit(batch).cast("long"), "_nth": F.monotonically_increasing_id()}).write.mode("append").parquet(path)


def read_changes(spark, root: str, table: str) -> DataFrame:
    """The table that a log makes: of each id the last row, unless it went. One aggregate, which combines before its shuffle."""
    last = spark.read.parquet(f"{root}/{table}").groupBy("_id").agg(F.max_by("row", F.struct("_batch", "_nth")).alias("row"))
    return last.where("row IS NOT NULL").select("row.*")


def split_book(docs: DataFrame, pages: DataFrame, page_id, left: DataFrame, right: DataFrame, now: int) -> Store:
    """A page that shows an open book becomes two: left takes its place, right follows it; neither keeps marks, read text or rotation."""
    doc_id = pages.where(F.col("id") == F.lit(page_id)).select("doc_id").first()
    if doc_id is None:
        return docs, pages
    fresh = lambda p: p.withColumns({c: F.lit(v).cast(pages.schema[c].dataType) for c, v in (("marcas", None), ("ocr", None), ("rotacion", 0)) if c in pages.columns})
    left = fresh(left).withColumn("id", F.lit(page_id).cast(pages.schema["id"].dataType)).withColumn("doc_id", F.lit(doc_id[0]))
    return insert_page_after(docs, upsert(pages, left), doc_id[0], fresh(right), page_id, now)


def save_cover(docs: DataFrame, pages: DataFrame, doc_id, cover: DataFrame, now: int) -> Store:
    """A document's cover page: new content under the old id, time and marks where there is one, else a new first page."""
    old = pages.where((F.col("doc_id") == F.lit(doc_id)) & (F.col("modo") == "portada") & F.col("papelera").isNull()).select("id").first()
    if old is None:
        return insert_page_at(docs, pages, doc_id, cover, 0, now)
    kept = pages.where(F.col("id") == F.lit(old.id)).select(*[F.col(c).alias(f"_{c}") for c in ("id", "doc_id", "creada", "marcas") if c in pages.columns])
    names = [c[1:] for c in kept.columns]
    new = cover.drop(*names).crossJoin(kept).withColumnsRenamed({f"_{c}": c for c in names})  # one row by one row
    return _change(docs, doc_id, modificado=F.lit(now)), upsert(pages, new)


def lock_settings(settings: F.Column, pin: str | None = None, wait_ms: int | None = None, without_fingerprint: bool = False, removed: bool = False) -> F.Column:
    """A settings map after a change to its lock: a new PIN keeps wait and fingerprint and forgets failures; removing the lock removes all of it."""
    lock = ("pin", "espera", "huella", "fallos", "hasta")
    if removed:
        return F.map_filter(settings, lambda k, v: ~k.isin(*lock))
    new = {k: v for k, v in (("pin", pin), ("espera", None if wait_ms is None else str(wait_ms))) if v is not None}
    gone = [*new, *(("fallos", "hasta") if pin is not None else ()), *(("huella",) if without_fingerprint else ())]
    kept = F.map_filter(settings, lambda k, v: ~k.isin(*gone)) if gone else settings
    return F.map_concat(kept, F.create_map(*[F.lit(x) for kv in new.items() for x in kv]).cast("map<string,string>")) if new else kept
