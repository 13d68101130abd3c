"""Listings, joins and aggregates over folders, documents and pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

COLLATION = "es_CI_AI"


def live(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("papelera").isNull())


def newest(docs: DataFrame, changed: str, key: str, most: int | None = None) -> DataFrame:
    """Newest first; equal times in order of key."""
    out = docs.orderBy(F.desc(changed), F.asc(key))
    return out if most is None else out.limit(most)


def in_folder(docs: DataFrame, folders: DataFrame, folder_id) -> DataFrame:
    """Documents of a folder; of all folders if there is none of that id."""
    here = folders.where(F.col("id") == F.lit(folder_id)).agg((F.count("*") > 0).alias("_there"))
    return docs.join(F.broadcast(here), how="cross").where(~F.col("_there") | (F.col("carpeta_id") == F.lit(folder_id))).drop("_there")  # one row


def by_key(rows: DataFrame, value, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == F.lit(value))


def page_keys(pages: DataFrame, doc_id) -> DataFrame:
    return pages.where(F.col("doc_id") == F.lit(doc_id)).select("id")


def pages_of(docs: DataFrame, pages: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each document's pages that exist, in order: pos is the place in the array, n counts only those that exist. carry: columns of docs to keep."""
    listed = docs.select(F.col("id").alias("_doc"), *carry, F.posexplode("paginas").alias("pos", "_page"))
    joined = listed.join(pages, F.col("_page") == pages["id"]).drop("_page")
    return joined.withColumn("n", F.row_number().over(Window.partitionBy("_doc").orderBy("pos"))).withColumnRenamed("_doc", "of")


def cover_page(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their first page's thumbnail, null where there is no page."""
    first = docs.withColumn("_first", F.try_element_at("paginas", F.lit(1)))
    return first.join(pages.select(F.col("id").alias("_first"), "miniatura"), "_first", "left").drop("_first")


def with_folder(docs: DataFrame, folders: DataFrame, key: str = "folder_id") -> DataFrame:
    return docs.join(folders, key, "left")


def without_dangling_folder(docs: DataFrame, folders: DataFrame, key: str = "folder_id") -> DataFrame:
    """The folder id stays only if that folder exists."""
    there = folders.select(F.col(key).alias("_there")).distinct()
    columns = [F.col("_there").alias(c) if c == key else F.col(c) for c in docs.columns]
    return docs.join(there, docs[key] == F.col("_there"), "left").select(*columns)


def unread(pages: DataFrame, read: DataFrame, key: str) -> DataFrame:
    return pages.join(read.select(key), key, "left_anti").select(key)


def trash(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """Trashed documents, and trashed pages whose document exists and isn't trashed, newest first."""
    gone = docs.where("trashed IS NOT NULL").select(F.lit("document").alias("kind"), "id", F.lit(None).cast("long").alias("parent"), "trashed")
    parents = docs.where("trashed IS NULL").select(F.col("id").alias("doc_id"))
    loose = pages.where("trashed IS NOT NULL").join(parents, "doc_id").select(F.lit("page").alias("kind"), "id", F.col("doc_id").alias("parent"), "trashed")
    return gone.unionByName(loose).orderBy(F.desc("trashed"), "kind", "id")


def folders_sorted(folders: DataFrame) -> DataFrame:
    return folders.orderBy(F.collate("nombre", COLLATION), "id")


def same_name(a: Column, b: Column) -> Column:
    """Equal but for case and accents, as Spanish sees it: ñ is not n."""
    return F.collate(a, COLLATION) == F.collate(b, COLLATION)


def folders_numbered(folders: DataFrame) -> DataFrame:
    """Folders with their place n in the order of folders_sorted. There are few folders."""
    return folders.withColumn("n", F.row_number().over(Window.orderBy(F.collate("nombre", COLLATION), "id")).cast("long"))


def folder_counts(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Each folder with how many documents it has; they are counted before the join."""
    n = docs.groupBy("carpeta_id").agg(F.count("*").alias("documents"))
    return folders.join(n, F.col("id") == F.col("carpeta_id"), "left").drop("carpeta_id").withColumn("documents", F.coalesce("documents", F.lit(0).cast("long")))


def trash_counts(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: how many documents and how many pages are trashed."""
    gone = docs.where("papelera IS NOT NULL").select(F.lit(1).alias("d")).unionByName(pages.where("papelera IS NOT NULL").select(F.lit(0).alias("d")))
    return gone.agg(F.count_if(F.col("d") == 1).alias("documents"), F.count_if(F.col("d") == 0).alias("pages"))


def free_name(wanted: DataFrame, taken: DataFrame, scope: list[str], base: str) -> DataFrame:
    """The first of base, base (2), base (3), … that taken (scope, name) doesn't hold, for each row of wanted (scope, base).

    Names with a number are taken apart; of a base's numbers, kept once each and in order, the first that isn't its own rank ends the run from 1.
    """
    numbered = r"(?s)^(.*) \(([1-9]\d{0,17})\)$"
    whole = taken.select(*scope, F.col("name").alias("_base"), F.lit(1).cast("long").alias("_n"))
    parted = taken.where(F.rlike("name", F.lit(numbered))).select(*scope, F.regexp_extract("name", numbered, 1).alias("_base"), F.regexp_extract("name", numbered, 2).cast("long").alias("_n")).where("_n > 1")
    keys = wanted.select(*scope, F.col(base).alias("_base")).distinct()
    used = whole.unionByName(parted).join(keys, [*scope, "_base"], "left_semi").distinct()
    ranked = used.withColumn("_rank", F.row_number().over(Window.partitionBy(*scope, "_base").orderBy("_n")))
    run = ranked.where("_n = _rank").groupBy(*scope, "_base").agg(F.max("_n").alias("_run"))
    out = wanted.join(run.withColumnRenamed("_base", base), [*scope, base], "left")
    n = F.coalesce("_run", F.lit(0)) + 1
    return out.select(*wanted.columns, F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit(" ("), n.cast("string"), F.lit(")"))).alias("name"))


def recent_distinct(rows: DataFrame, key: str, value: str, at: str, most: int) -> DataFrame:
    """Each key's most recent distinct values, n from 1."""
    last = rows.groupBy(key, value).agg(F.max(at).alias(at))
    return last.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), value))).where(F.col("n") <= most)


def nearest_previous(rows: DataFrame, group: str, place: str, key: str, item: str, alike: Callable[[Column, Column], Column], most: int, stretch: int = 5000) -> DataFrame:
    """For each row the nearest earlier one of its group, at most `most` places before, that is alike: (key, twin). Rows that aren't comparable (item null) take up places.

    A group's places are dealt in stretches, each with the `most` rows before it, so a large group is many tasks' work; within a
    stretch the earlier rows come from a window, and no pairs are made.
    """
    own = F.floor(F.col("_p") / stretch)
    a = rows.select(F.col(group).alias("_g"), F.col(place).alias("_p"), F.col(key), F.col(item).alias("_item"))
    a = a.withColumn("_s", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_p") + most) / stretch)))))
    w = Window.partitionBy("_g", "_s").orderBy("_p")
    before = [F.lag(F.struct("_p", key, "_item"), k).over(w).alias(f"_b{k}") for k in range(1, most + 1)]
    a = a.select("*", *before).where(own == F.col("_s"))
    near = [F.when((F.col(f"_b{k}._p") >= F.col("_p") - most) & F.col(f"_b{k}._item").isNotNull() & alike(F.col("_item"), F.col(f"_b{k}._item")), F.col(f"_b{k}.{key}")) for k in range(1, most + 1)]
    return a.where(F.col("_item").isNotNull()).select(key, F.coalesce(*near).alias("twin")).where("twin IS NOT NULL")


def numbered(rows: DataFrame, group: str, order: str, name: str = "n", stretches: int = 64) -> DataFrame:
    """rows with their place within their group (from 1) by a column, in which a group may be most of the rows.

    Ranges of (group, order), which Spark cuts evenly, are numbered each by itself; a group's rows in the ranges before come from their counts.
    """
    ranged = rows.repartitionByRange(stretches, F.col(group).asc_nulls_first(), F.col(order).asc_nulls_first()).withColumn("_r", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    counts = ranged.groupBy(F.col(group).alias("_g"), F.col("_r").alias("_s")).agg(F.count("*").alias("_n"))
    before = counts.select("_g", "_s", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_s")) - F.col("_n")).alias("_before"))  # a row for each group and range
    nth = F.row_number().over(Window.partitionBy(group, "_r").orderBy(F.col(order).asc_nulls_first()))
    out = ranged.withColumn(name, nth).join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_r") == F.col("_s")))
    return out.select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))


def sliding(rows: DataFrame, key: str, order: list[str], value: str, reach: int) -> DataFrame:
    """rows with mean, top and low of a value over `reach` rows before and after within their key, or what there is of them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-reach, reach)
    return rows.select("*", F.avg(value).over(w).alias("mean"), F.max(value).over(w).alias("top"), F.min(value).over(w).alias("low"))


def unread_count(pages: DataFrame, read: DataFrame, key: str) -> DataFrame:
    """One row: how many pages have not been read, and how many there are."""
    marked = pages.select(key).join(read.select(F.col(key).alias("_read")).distinct(), F.col(key) == F.col("_read"), "left")
    return marked.agg(F.count_if(F.col("_read").isNull()).alias("unread"), F.count("*").alias("pages"))


def distinct_in_order(rows: DataFrame, key: str, value: str, at: str, name: str = "values") -> DataFrame:
    """For each key its distinct values in order of their first time; equal times in order of value. Values are first told apart, so a list holds each once."""
    first = rows.groupBy(key, value).agg(F.min(at).alias("_at"))
    lists = first.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", value))).alias("_l"))
    return lists.select(key, F.transform("_l", lambda x: x[value]).alias(name))


def span(docs: DataFrame, changed: Column) -> DataFrame:
    """One row: the last and first change, and how many documents."""
    return docs.agg(F.max(changed).alias("changed"), F.min(changed).alias("created"), F.count("*").alias("documents"))


def value_percentiles(rows: DataFrame, key: str, value: str, wanted: dict[str, float]) -> DataFrame:
    """For each key and name the item floor(n p), from 0, of its sorted values, not interpolated. Nulls don't count; NaN is the greatest, as for Spark.

    Each pass counts what is left of an item's range in 256 bins of equal width and goes on with the bin that has the item, from its least to its greatest value, until these
    are one. So nothing is sorted, and no window or task has more than an item's bins. Values are counted once first; most items take three or four passes.
    """
    held = written(rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n")), "values")
    real = rows.schema[value].dataType.typeName() in ("double", "float")
    v, low, high = F.col("_v"), F.col("low"), F.col("high")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v) if real else v
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in wanted.items()]))
    ends = held.groupBy("_key").agg(F.sum("_n").alias("_all"), F.min(v).alias("least"), F.max(v).alias("most"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    items = ends.select("*", names.alias("x")).select(F.col("_key").alias("_k"), "x.name", F.least(F.floor(F.col("_all") * F.col("x.p")), F.col("_all") - 1).alias("rank"), "least", "most", "low", "high")
    if real:  # halves, as a difference may be out of range; where it is below what is one, the least value is parted from the rest
        width = high / 2 - low / 2
        nth = F.when(width > 0, F.least(F.floor((v / 2 - low / 2) / width * 256), F.lit(255))).otherwise(F.when(v == low, 0).otherwise(255))
        bin_ = F.when(F.isnan(v), 257).when(v == float("inf"), 256).when(v == float("-inf"), -1).otherwise(nth)
    else:
        exact = lambda c: c.cast("decimal(38,6)")
        width = exact(high) - exact(low)
        bin_ = F.when(width == 0, 0).otherwise(F.least(F.floor((exact(v) - exact(low)) * 256 / width), F.lit(255)))
    items = written(items, "items")
    while not items.where(~F.col("least").eqNullSafe(F.col("most"))).isEmpty():
        near = items.join(held, F.col("_k").eqNullSafe(F.col("_key")) & (v >= F.col("least")) & (v <= F.col("most")))
        bins = near.groupBy("_k", "name", "rank", bin_.cast("int").alias("bin")).agg(F.sum("_n").alias("_n"), F.min(v).alias("least"), F.max(v).alias("most"), F.min(finite).alias("low"), F.max(finite).alias("high"))
        upto = bins.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_k", "name").orderBy("bin")))  # 259 rows at most
        here = upto.where("_upto > rank AND _upto - _n <= rank").withColumn("rank", F.col("rank") - F.col("_upto") + F.col("_n"))
        items = written(here.select("_k", "name", "rank", "least", "most", "low", "high"), "items")
    return items.groupBy(F.col("_k").alias(key)).agg(*[F.max(F.when(F.col("name") == n, F.col("least"))).alias(n) for n in wanted])


def bin_percentiles(bins: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """bins (bin, n): for each name the first bin up to which its share of all lies. A histogram has few rows."""
    upto = bins.withColumn("_upto", F.sum("n").over(Window.orderBy("bin"))).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    return upto.agg(*[F.min(F.when(F.col("_upto") >= p * F.col("_all"), F.col("bin"))).cast("long").alias(name) for name, p in wanted.items()])


def dominant_sign(rows: DataFrame, key: str, value: str) -> DataFrame:
    """For each key the sign (-1 or 1) that most of its values have, by their total strength where as many have either; positive where that is equal too. Zeros don't count."""
    sides = rows.where(F.col(value) != 0).groupBy(key, F.signum(value).cast("int").alias("sign")).agg(F.count("*").alias("n"), F.sum(F.abs(value)).alias("strength"))
    return sides.groupBy(key).agg(F.max(F.struct("n", "strength", "sign"))["sign"].alias("sign"))


def otsu(bins: DataFrame) -> DataFrame:
    """The bin that best parts a histogram (bin, n) in two classes; the first of equals."""
    w, everything = Window.orderBy("bin"), Window.partitionBy()
    c = bins.select("bin", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("bin")).over(w).alias("s0"), F.sum("n").over(everything).alias("w"), F.sum(F.col("n") * F.col("bin")).over(everything).alias("s"))
    rest = F.col("w") - F.col("w0")
    spread = F.when(rest > 0, F.col("w0").cast("double") * rest * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / rest, 2)).otherwise(0.0)
    return c.withColumn("v", spread).orderBy(F.desc("v"), "bin").limit(1).select(F.col("bin").alias("threshold"))


def runs(rows: DataFrame, key: str, at: str, gap) -> DataFrame:
    """Runs of rows no further apart than gap: run from 1, first, last, n."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    marked = rows.withColumn("_new", new)
    marked = marked.withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def sheets(rows: DataFrame, place: str, each: int) -> DataFrame:
    """N-up layout: the sheet and the cell of each page, from 0."""
    return rows.withColumn("sheet", F.floor(F.col(place) / each).cast("long")).withColumn("cell", F.pmod(place, F.lit(each)).cast("long"))


def sheet_orientation(pages: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sheets of a document stand upright if half its pages or more do."""
    return pages.groupBy(doc).agg((F.avg((F.col("alto") >= F.col("ancho")).cast("int")) >= 0.5).alias("upright"))


def blurry(p: DataFrame) -> Column:
    return (p["filtro"] != "dibujo") & p["nitidez"].isNotNull() & (p["nitidez"] < 0.25)


def comparable(p: DataFrame) -> Column:
    """Pages that are looked at for repeats: not trashed, covers, PDF pages or cleared ones."""
    return p["papelera"].isNull() & ~F.coalesce(p["modo"], F.lit("")).isin("portada", "pdf") & ~F.coalesce(p["no_repetida"], F.lit(False))


def still_repeated(page_flag: Column, doc_pages: Column) -> Column:
    return page_flag.isNotNull() & F.coalesce(F.array_contains(doc_pages, page_flag), F.lit(False))


def has_highlights(marks: Column) -> Column:
    return F.coalesce(F.exists(marks, lambda m: m["tipo"] == "resaltador"), F.lit(False))


def mergeable(docs: DataFrame, other_than) -> DataFrame:
    """What a document can be joined with."""
    return docs.where((F.col("id") != F.lit(other_than)) & (F.size("paginas") > 0) & F.col("papelera").isNull())


def has_cover(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.max(F.coalesce(F.col("modo") == "portada", F.lit(False))).alias("has_cover"))


def convex(q: Column) -> Column:
    """A quadrilateral, array of struct(x, y), whose turns all go one way."""
    at = lambda i: F.get(q, F.lit(i % 4))
    turn = [(at(i + 1)["x"] - at(i)["x"]) * (at(i + 2)["y"] - at(i + 1)["y"]) - (at(i + 1)["y"] - at(i)["y"]) * (at(i + 2)["x"] - at(i + 1)["x"]) for i in range(4)]
    return (F.least(*turn) > 0) | (F.greatest(*turn) < 0)


def settings(stored: Column, defaults: dict[str, str], removed: tuple[str, ...] = ()) -> Column:
    """Settings: what is stored over the defaults; text that isn't JSON counts as nothing stored."""
    got = F.coalesce(F.from_json(stored, "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]).cast("map<string,string>")
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(got, k))
    return F.map_filter(F.map_concat(kept, got), lambda k, v: ~k.isin(*removed) if removed else F.lit(True))


def cover_defaults(docs: DataFrame, fields: list[str]) -> DataFrame:
    """docs with structs actual, perfil and clase: each field from the cover as it is, else the profile's, else the class's."""
    whole = F.col("actual").isNotNull()
    pick = lambda f: F.when(whole, F.col(f"actual.{f}")).otherwise(F.coalesce(F.nullif(F.col(f"perfil.{f}"), F.lit("")), F.nullif(F.col(f"clase.{f}"), F.lit("")), F.lit("")))
    return docs.withColumn("portada", F.struct(*[pick(f).alias(f) for f in fields]))
