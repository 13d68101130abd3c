"""Golden values of the library's functions, and its operators over small stores."""

import io
import json
import zipfile
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pliego import plans
from pliego.functions import arrays, codes, dates, text
from pliego.operators import commands, duplicates, highlights, images, layout, library, search
from pliego.sources import files, pdf, sinks
from pliego.sources.encryption import Lock
from pliego.streaming import capture

DAY = dates.DAY


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lit(value):
    return F.lit(value)


def test_search_functions(spark):
    assert one(spark, text.fold(lit("Cálculo AÑO Pingüino ß"))) == "calculo ano pinguino ß"
    assert text.terms_here("  Límites   y  DERIVADAS ") == ["limites", "y", "derivadas"] == list(one(spark, text.terms(lit("  Límites   y  DERIVADAS "))))
    found = lambda t, q: one(spark, text.has_terms(text.fold(lit(t)), text.terms_here(q)))
    body = "El procedimiento de determinación de los tributos"
    assert found(body, "tributos determinacion") and not found(body, "tributos aduana") and not found("", "x") and not found(body, "")
    full = lit("El señor, con un Oficio\nlargo y  más palabras que siguen aquí todavía")
    hit = text.hit(full, ["oficio"])
    s = one(spark, text.snippet(full, hit["start"], hit["end"], around=10))
    assert (s.before, s.mark, s.after) == ("…señor, con un ", "Oficio", " largo y más…")


def store(spark):
    docs = spark.createDataFrame([("d1", "Tarea de Cálculo", 1, 5, ["p1", "px", "p2"], "f1", None), ("d2", "Historia", 2, 9, ["p3"], None, None), ("d3", "Viejo", 1, 1, ["p4"], None, 7)], "id string, nombre string, creado long, modificado long, paginas array<string>, carpeta_id string, papelera long")
    pages = spark.createDataFrame([("p1", "d1", "Límites y derivadas.", None), ("p2", "d1", "La derivada en 1821.", None), ("p3", "d2", "La independencia fue en 1821.", None), ("p4", "d3", "1821", None)], f"id string, doc_id string, texto string, papelera {commands.TRASHED}")
    return docs, pages, spark.createDataFrame([("f1", "Mate", 1)], "id string, nombre string, creada long")


def test_search(spark):
    docs, pages, folders = store(spark)
    found = lambda q: [(r.doc_id, r.n, r.more, r.in_name) for r in search.search(docs, pages, folders, q).collect()]
    assert found("1821") == [("d2", 1, 0, False), ("d1", 3, 0, False)]
    assert found("CALCULO") == [("d1", None, None, True)] and found("calculo derivadas") == [] and found("química") == [] and found(" ") == []
    assert found("deriva") == [("d1", 1, 1, False)]


def test_listings(spark):
    docs, pages, folders = store(spark)
    assert [(r.of, r.pos, r.n, r.id) for r in library.pages_of(docs, pages).orderBy("of", "pos").collect()] == [("d1", 0, 1, "p1"), ("d1", 2, 2, "p2"), ("d2", 0, 1, "p3"), ("d3", 0, 1, "p4")]
    assert [r.id for r in library.newest(library.live(docs), "modificado", "id").collect()] == ["d2", "d1"]
    assert library.in_folder(docs, folders, "f1").count() == 1 and library.in_folder(docs, folders, "gone").count() == 3
    names = spark.createDataFrame([(n,) for n in ("zorro", "ñu", "nube", "Árbol", "nz", "Física", "Cálculo", "calculo")], "nombre string").withColumn("id", F.col("nombre"))
    assert [r.nombre for r in library.folders_sorted(names).collect()] == ["Árbol", "Cálculo", "calculo", "Física", "nube", "nz", "ñu", "zorro"]
    assert one(spark, library.same_name(lit("CÁLCULO"), lit("calculo"))) and not one(spark, library.same_name(lit("Año"), lit("ano")))


def test_texts(spark):
    assert one(spark, text.join_hyphens(lit("instalacio-\nnes\nAd-\nAduanera"))) == "instalaciones\nAd-\nAduanera"
    got = one(spark, text.paragraphs(lit("Los su-\njetos de\nla ley.\n\n1) uno\n2) dos y\nmás\na) tres")))
    assert got == ["Los sujetos de la ley.", "1) uno", "2) dos y más", "a) tres"] and one(spark, text.paragraphs(lit(""))) == []
    body = "Artículo 122. Esto sigue aquí; y más. " + "palabra, " * 60
    pieces = text.sentences_here(body)
    assert all(b - a <= 220 for a, b, _ in pieces) and "".join(body[a:b] for a, b, _ in pieces).split() == body.split() and text.sentences_here(" \n ") == []
    joined = text.with_page_headers(F.array(F.struct(lit(1).alias("n"), lit("a").alias("text")), F.struct(lit(3).alias("n"), lit("b\nc").alias("text"))))
    assert one(spark, joined) == "— Página 1 —\na\n\n— Página 3 —\nb\nc"
    assert [(r.n, r.text) for r in one(spark, text.split_by_headers(joined))] == [(1, "a"), (3, "b\nc")]
    segments = one(spark, text.translation_segments(lit("— Página 1 —\nHola mundo.\nSegundo renglón.\n\nAdiós.")))
    assert [s.text for s in segments if s.translate] == ["Hola mundo.\nSegundo renglón.", "Adiós."]
    assert one(spark, text.xml_escape(lit("a<b>&\x01"))) == "a&lt;b&gt;&amp;"
    assert one(spark, text.human_size(lit(1500))) == "1 KB" and one(spark, text.human_size(lit(1572864))) == "1,5 MB"
    assert one(spark, text.file_name(lit(' a/b:*  c '), "pdf")) == "a b c.pdf" and one(spark, text.file_name(lit("??"), "zip")) == "Escaneo.zip"
    assert one(spark, text.next_place(lit("uno dos uno"), lit("uno"), lit(1))) == 8
    assert one(spark, arrays.ranges(F.array(*map(F.lit, (7, 2, 3, 4))))) == "2–4, 7"


def test_codes(spark):
    get = lambda t: one(spark, codes.classify(lit(t)))
    r = get("https://www.unah.edu.hn/matricula?x=1")
    assert (r.tipo, r.sitio, r.seguro) == ("enlace", "unah.edu.hn", True) and get("http://ejemplo.com").seguro is False and get("www.ejemplo.com").url == "https://www.ejemplo.com"
    r = get(r"WIFI:T:WPA;S:Biblioteca UNAH;P:clave\;segura;;")
    assert (r.tipo, r.red, r.clave, r.seguridad, r.oculta) == ("wifi", "Biblioteca UNAH", "clave;segura", "WPA", False)
    assert get("mailto:tareas@ejemplo.com?subject=Hola").correo == "tareas@ejemplo.com" and get("tel:+50422223333").telefono == "+50422223333"
    r = get("BEGIN:VCARD\nVERSION:3.0\nFN:Ana Martínez\nTEL:+50499998888\nEND:VCARD")
    assert (r.tipo, r.nombre, r.telefono) == ("contacto", "Ana Martínez", "+50499998888")
    assert get("MECARD:N:Ruiz,Ana;TEL:1;;").nombre == "Ana Ruiz" and get("  Aula 204 ").texto == "Aula 204"
    for scheme in ("javascript:", "data:", "vbscript:", "file:", "blob:", "intent:", "about:"):
        r = get(scheme + "alert(1)")
        assert r.tipo == "texto" and r.url is None


def test_times(spark):
    now = 1_790_553_600_000
    ago = lambda d: now - d * DAY if d is not None else None
    cases = [([], None, None, None), ([(3, 3)], None, None, None), ([(3, 3), (8, 8)], None, None, (True, 8)), ([(60, 45)], 40, None, None), ([(60, 2)], 10, None, None), ([(60, 2)], 40, None, (False, 40)), ([(20, 20)], None, 2, None), ([(20, 20)], None, 8, (True, 20))]
    for docs, last, snoozed, want in cases:
        made, changed = (min((ago(c) for c, _ in docs), default=now), max((ago(m) for _, m in docs), default=0))
        got = one(spark, dates.reminder(lit(len(docs)), lit(made), lit(changed), lit(ago(last)).cast("long"), lit(ago(snoozed)).cast("long"), lit(now)))
        assert (None if got is None else tuple(got)) == want
    assert [one(spark, dates.backoff(lit(n))) for n in (4, 5, 6, 7, 20)] == [0, 30_000, 60_000, 120_000, 900_000]
    assert one(spark, dates.default_name(lit(1_790_505_720_000))) == "Escaneo 27 sept 2026 10.42"
    assert one(spark, files.crc32(lit("123456789").cast("binary"))) == 0xCBF43926


def test_ordered_arrays(spark):
    a = F.array(*map(F.lit, ("a", "b", "a", "c")))
    assert one(spark, arrays.without(a, F.array(lit("b")))) == ["a", "a", "c"]
    assert one(spark, arrays.insert_at(a, lit("z"), lit(99))) == ["a", "b", "a", "c", "z"] and one(spark, arrays.insert_at(a, lit("z"), lit(-1)))[0] == "z"
    assert one(spark, arrays.insert_after(a, lit("z"), lit("b"))) == ["a", "b", "z", "a", "c"]
    assert one(spark, arrays.swap(a, lit(0), lit(1))) == ["b", "a", "a", "c"] and one(spark, arrays.swap(a, lit(0), lit(9))) == ["a", "b", "a", "c"]
    assert one(spark, arrays.recent(a, 2)) == ["a", "c"] and one(spark, arrays.upper_median(F.array(lit(1), lit(2)))) == 2


def shape(docs, pages):
    return {r.id: r.paginas for r in docs.collect()}, {r.id: (r.doc_id, None if r.papelera is None else tuple(r.papelera)) for r in pages.collect()}


def test_commands(spark):
    docs, pages, _ = store(spark)
    new = spark.createDataFrame([("n1", None, "x", None)], pages.schema)
    assert shape(*commands.append_page(docs, pages, "d2", new, 10))[0]["d2"] == ["p3", "n1"]
    assert shape(*commands.insert_page_after(docs, pages, "d1", new, "p1", 10))[0]["d1"] == ["p1", "n1", "px", "p2"]
    assert shape(*commands.insert_page_at(docs, pages, "d1", new, 99, 10))[0]["d1"][-1] == "n1"
    with pytest.raises(KeyError):
        commands.append_page(docs, pages, "none", new, 10)
    d, p = shape(*commands.move_pages(docs, pages, "d1", "d2", ["p2", "p1"], 10))
    assert d["d1"] == ["px"] and d["d2"] == ["p3", "p1", "p2"] and p["p1"][0] == "d2"
    d, p = shape(*commands.merge_documents(docs, pages, "d2", "d1", 10))
    assert "d1" not in d and d["d2"] == ["p3", "p1", "px", "p2"]
    d, p = shape(*commands.split_document(docs, pages, "d1", 2, spark.createDataFrame([("d9", "n", 1, 1, None, None)], "id string, nombre string, creado long, modificado long, carpeta_id string, papelera long"), 10))
    assert d["d1"] == ["p1"] and d["d9"] == ["px", "p2"] and p["p2"][0] == "d9"
    gone = commands.trash_pages(docs, pages, "d1", ["p1", "p2", "p3"], 50)
    d, p = shape(*gone)
    assert d["d1"] == ["px"] and p["p1"] == ("d1", (50, 0)) and p["p2"] == ("d1", (50, 2)) and p["p3"] == ("d2", None)
    back = commands.restore_page(*commands.restore_page(*gone, "p1"), "p2")
    assert shape(*back)[0]["d1"] == ["p1", "px", "p2"]
    orphan = (gone[0].where("id <> 'd1'"), gone[1])
    assert shape(*commands.restore_page(*orphan, "p1"))[1]["p1"][1] == (50, 0)
    late = 50 + 31 * DAY
    assert commands.purge_count(*gone, late).first().purged == 3  # d3 and two loose pages
    d, p = shape(*commands.purge(*gone, late))
    assert set(d) == {"d1", "d2"} and set(p) == {"p3"}
    assert shape(*commands.purge(*gone, 7 + 30 * DAY))[0].keys() == {"d1", "d2", "d3"}  # thirty days to the moment isn't over
    assert commands.reorder_pages(docs, "d1", ["p2", "nope", "p1"], 1).where("id = 'd1'").first().paginas == ["p2", "p1", "px"]


def test_snapshots_flip_whole(spark, tmp_path):
    docs, pages, _ = store(spark)
    root = f"file://{tmp_path}"
    commands.write_snapshot(root, "s1", docs=docs, pages=pages)
    commands.write_snapshot(root, "s2", docs=docs.limit(1), pages=pages)
    assert commands.read_snapshot(spark, root, "docs").count() == 1


def test_reading_order(spark):
    chunk = lambda s, x, y, h, w: {"str": s, "x": x, "y": y, "h": h, "w": w}
    said, lines = layout.lines_of_chunks(pd.DataFrame([chunk("mundo", 160, 100, 20, 60), chunk("Hola ", 100, 101, 20, 55), chunk("Segundo renglón", 100, 125, 20, 180), chunk("Otro párrafo", 100, 200, 20, 140), chunk("  ", 0, 0, 20, 5)]))
    assert said == "Hola mundo\nSegundo renglón\n\nOtro párrafo" and len(lines) == 3
    assert (lines[0]["palabras"][0]["x0"], lines[0]["palabras"][0]["x1"]) == (100, 144)
    assert layout.lines_of_chunks(pd.DataFrame([chunk("Mate", 100, 50, 12, 28), chunk("mática básica", 128, 50, 12, 78)]))[0] == "Matemática básica"
    word = "struct<text:string,confidence:double,bbox:struct<x0:int,y0:int,x1:int,y1:int>>"
    schema = f"blocks array<struct<paragraphs:array<struct<lines:array<struct<bbox:struct<y0:int,y1:int>,baseline:struct<x0:int,y0:int,x1:int,y1:int>,confidence:double,words:array<{word}>>>>>>>"
    line = lambda words, sure=90.0: ((0, 10), None, sure, [(w, float(c), (0, 0, 5, 5)) for w, c in words])
    read = lambda *paragraphs: spark.createDataFrame([([([(list(p),) for p in paragraphs],)],)], schema).select(layout.read_tree(F.col("blocks")).alias("r")).first().r
    got = read([line([("Hola", 95), ("mundo", 95)]), line([("—", 95), ("==", 95)])], [line([("1821.", 95)])])
    assert got.text == "Hola mundo\n\n1821." and len(got.lines) == 2
    got = read([line([(w, 95) for w in ("Etapas", "del", "procedimiento")] + [("E", 20), ("|", 60)]), line([("L-", 0), ("aa", 34), ("do", 64)], 21.0), line([("Rano", 14), ("competente", 95), ("tributarios", 19), ("Ses", 20)])])
    assert got.text == "Etapas del procedimiento\ncompetente tributarios"
    got = read([line([("las", 95), ("instalacio-", 95)]), line([("nes", 95), ("o", 95), ("domicilio;", 95)]), line([("Ad-", 95)]), line([("Aduanera", 95)])])
    assert got.text == "las instalaciones o domicilio;\nAd-\nAduanera" and len(got.lines) == 4


def test_highlights(spark):
    said = [(0, "La célula es".split()), (1, "algo y la unidad básica".split()), (2, "de la vida. Y más".split())]
    words = [("g", n, k, w, 100 + 100 * k, 80 + 100 * n, 180 + 100 * k, 120 + 100 * n) for n, ws in said for k, w in enumerate(ws)]
    strokes = [("g", 0, "amarillo", 0.05, [0.3, 200 / 700, 0.6, 200 / 700]), ("g", 1, "amarillo", 0.05, [0.1, 300 / 700, 0.36, 300 / 700]), ("g", 2, "verde", 0.05, [0.2, 100 / 700, 0.27, 100 / 700]), ("g", 3, "verde", 0.05, [0.1, 0.9, 0.3, 0.9])]
    s = spark.createDataFrame([(*x, 1000.0, 700.0) for x in strokes], "page_id string, stroke int, color string, thickness double, points array<double>, width double, height double")
    w = spark.createDataFrame(words, "page_id string, line int, word int, t string, x0 int, y0 int, x1 int, y1 int")
    assert [(r.color, r.text) for r in highlights.highlighted(s, w).orderBy("part").collect()] == [("verde", "célula"), ("amarillo", "la unidad básica de la vida.")]
    turned = highlights.turn_strokes(spark.createDataFrame([([0.2, 0.3, 0.4, 0.3], 0.01, 800.0, 1100.0)], "points array<double>, thickness double, width double, height double"), 1).first()
    assert turned.points == pytest.approx([0.7, 0.2, 0.7, 0.4])


STROKE = "page_id string, stroke int, color string, thickness double, points array<double>, width double, height double"


@pytest.mark.parametrize("half, px, py, ax, ay, dx, dy, touched", [(10, 392, 696, 377, 701, 720, 210, True), (10, 553, 1002, 541, 993, 63, 216, True), (14, 527, 760, 518, 769, 32, 24, False), (18, 79, 504, 52, 504, 56, 42, False)])
def test_words_as_far_as_their_reach_are_touched_as_in_sql(spark, half, px, py, ax, ay, dx, dy, touched):
    s = spark.createDataFrame([("p", 0, "verde", 0.001, [ax / 1024, ay / 1024, (ax + dx) / 1024, (ay + dy) / 1024], 1024.0, 1024.0)], STROKE)
    w = spark.createDataFrame([("p", 0, 0, "a", px - 10, py - half, px + 10, py + half)], "page_id string, line int, word int, t string, x0 int, y0 int, x1 int, y1 int")
    assert (highlights.touching(s, w).count() == 1) == touched


def test_squares_stay_off_the_driver(spark, tmp_path):
    def stored(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    strokes = spark.createDataFrame([("p", 0, "verde", 0.01, [0.1, 0.1, 0.9, 0.9], 1024.0, 1024.0)], STROKE)
    words = spark.createDataFrame([("p", 0, 0, "a", 500, 500, 520, 520)], "page_id string, line int, word int, t string, x0 int, y0 int, x1 int, y1 int")
    box = F.struct(*[F.lit(500.0).alias(c) for c in "xywh"])
    marks = strokes.select("page_id", F.col("stroke").alias("mark"), F.lit("resaltador").alias("kind"), box.alias("box"), "thickness", "points", "width", "height")
    marks = marks.unionByName(marks.withColumns({"mark": F.col("mark") + 1, "kind": F.lit("nota")}))
    spots = words.select("page_id", F.lit(1).alias("point_id"), F.lit(510.0).alias("x"), F.lit(510.0).alias("y"))
    strokes, words, marks, spots = (stored(df, k) for k, df in {"s": strokes, "w": words, "m": marks, "p": spots}.items())
    for found in (highlights.touching(strokes, words), highlights.mark_at(marks, spots)):
        assert found.count() == 1 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_new_rows_come_whole_when_each_reading_has_another_order(spark):
    chance = F.udf(lambda i: __import__("os").urandom(8).hex(), "string").asNondeterministic()
    rows = spark.range(300).withColumn("text", F.lit("old"))
    new = spark.range(300).select("id", F.concat(F.lit("new"), "id").alias("text"), chance("id").alias("r")).orderBy("r").drop("r")
    got = commands.upsert(rows, new)
    assert sorted(tuple(r) for r in got.collect()) == [(k, f"new{k}") for k in range(300)]


def test_replaced_pages_of_a_long_conversation(spark, tmp_path):
    turns = [(c, t, "user", f"{c} {t}") for c in (0, 1) for t in range(1003)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = plans.queries()["replaced_pages"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted((c * 1000 + t, c, c * 1000 + t + 5, "new" if t == 1 else x) for c, t, _, x in turns)


def page(k, shift=(0, 0), lit=1.0, noise=0, size=(480, 360)):
    rng, img = np.random.default_rng(k), np.full((*size, 4), 235.0)
    for row in range(26):
        x, y = 25, 20 + row * 17
        while x < size[1] - 50:
            w = int(rng.integers(8, 45))
            img[y + shift[1] : y + 8 + shift[1], x + shift[0] : x + w + shift[0], :3] = 40
            x += w + int(rng.integers(5, 12))
    img[..., :3] = np.clip(img[..., :3] * lit + rng.integers(-noise, noise + 1, (*size, 1)) if noise else img[..., :3] * lit, 0, 255)
    return img.astype(np.uint8)


def test_repeated_pages(spark):
    first = duplicates.fingerprint(page(1))
    assert duplicates.similarity(first, duplicates.fingerprint(page(1, (6, 4), 0.88, 20))) >= 0.6
    assert max(duplicates.similarity(first, duplicates.fingerprint(page(k))) for k in range(2, 6)) < 0.4
    blank = duplicates.fingerprint(np.full((480, 360, 4), 255, np.uint8))
    assert not duplicates.fingerprint_alike(blank, blank) and duplicates.similarity(first, duplicates.fingerprint(page(1, size=(360, 480)))) == 0
    rows = [("d", n, f"p{n}", None, None, None, {"width": 360, "height": 480, "data": page(k).tobytes()}) for n, k in enumerate((1, 2, 1))]
    df = spark.createDataFrame(rows, "doc_id string, pos int, id string, papelera long, modo string, no_repetida boolean, image struct<width:int,height:int,data:binary>")
    marked = df.withColumn("mark", duplicates.fingerprints()("image"))
    assert [tuple(r) for r in duplicates.repeated_pages(marked, 3).collect()] == [("p2", "p0")]


def test_images():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    q = np.array([[10, 12], [200, 20], [190, 300], [5, 280]], float)
    assert images.project(images.homography(square, q), square) == pytest.approx(q, abs=1e-6)
    assert images.order_corners(q[[2, 0, 3, 1]]) == pytest.approx(q) and images.convex(q) and not images.convex(q[[0, 2, 1, 3]])
    img = page(3)
    assert (images.turn(images.turn(images.turn(images.turn(img, 1), 1), 1), 1) == img).all()
    scene = np.full((400, 300, 4), 60, np.uint8)
    scene[60:340, 50:250, :3] = 235
    corners, sure = images.find_sheet(scene)
    assert sure > 0.8 and corners == pytest.approx(np.array([[50 / 300, 60 / 400], [250 / 300, 60 / 400], [250 / 300, 340 / 400], [50 / 300, 340 / 400]]), abs=0.015)
    assert images.find_sheet(np.full((200, 200, 4), 128, np.uint8)) is None
    shaded = (img * np.linspace(0.6, 1, 360)[None, :, None]).astype(np.uint8)
    out = images.enhanced(shaded)[..., 0]
    assert out[:15].mean() > 245 and np.percentile(out, 5) < 110
    assert set(np.unique(images.black_white(shaded)[..., 0])) == {0, 255} and images.black_white(shaded)[:15, :, 0].mean() == 255
    assert images.sharpness(img) > 0.28 and images.sharpness(np.full((100, 100, 4), 200, np.uint8)) is None
    soft = img.astype(float)
    for _ in range(8):
        soft = sum(np.roll(soft, d, a) for a in (0, 1) for d in (-1, 0, 1)) / 6
    assert images.sharpness(soft.astype(np.uint8)) < 0.25
    assert images.motion(images.motion_frame(img), images.motion_frame((img * 0.8).astype(np.uint8))) < 0.3 and images.motion(np.ones((2, 3)), np.ones((3, 3))) == float("inf")
    book = np.concatenate([page(4), np.full((480, 40, 4), 235, np.uint8), page(5)], axis=1)
    book[:, 374:386, :3] = 190  # the fold's shadow
    assert images.gutter(book) == pytest.approx(0.5, abs=0.03) and images.gutter(img) is None
    assert images.light(img, 0, 0).tolist() == img.tolist()


def test_files(spark, tmp_path):
    data = sinks.zip_bytes([("respaldo.json", b"{}"), ("paginas/añadida-página.jpg", b"abc")])
    assert files.unzip(data) == [("respaldo.json", b"{}"), ("paginas/añadida-página.jpg", b"abc")]
    with pytest.raises(zipfile.BadZipFile):
        files.unzip(b"no zip")
    with pytest.raises(ValueError):
        files.unzip(sinks.zip_bytes([("big", b"x" * 100)]), most=50)
    assert sinks.pack_bits(np.array([[0] + [255] * 9, [255] * 9 + [0]], np.uint8)) == bytes([0b01111111, 0b11000000, 0b11111111, 0b10000000])
    assert [sinks.pdf_string(s) for s in ("Cálculo", "¿Año (ñ)?", "“x” – …", "日本")] == ["(C\\341lculo)", "(\\277A\\361o \\(\\361\\)?)", "(\\223x\\224 \\226 \\205)", "(??)"]
    bits = {"kind": "bits", "bytes": sinks.pack_bits(np.full((16, 8), 255)), "width": 8, "height": 16}
    pdf = sinks.pdf_bytes("Tarea", [bits] * 5, "a4", 4)
    assert pdf.startswith(b"%PDF-1.5") and pdf.count(b"/Type /Page ") == 2 and b"/Count 2" in pdf
    at = int(pdf.rsplit(b"startxref\n", 1)[1].split()[0])
    assert pdf[at : at + 4] == b"xref"
    assert b"/MediaBox [0 0 792 612]" in sinks.pdf_bytes("t", [bits] * 3, "carta", 2)
    rung, data = sinks.fit_budget(lambda side, quality: b"x" * int(side * side * (0.28 + 0.9 * quality * quality)), [(100, 0.9), (90, 0.8), (50, 0.5), (20, 0.4)], 2000)
    assert rung == 2 and len(data) <= 2000
    assert sinks.pin_is("1234", sinks.protect_pin("1234", b"salt", 1000)) and not sinks.pin_is("1235", sinks.protect_pin("1234", b"salt", 1000))
    assert files.jpeg_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x10\x00\x20\x03" + b"\0" * 12) == (32, 16, 3)


def test_backup_round_trip(spark):
    docs, pages, folders = store(spark)
    full = pages
    for c, t in (("filtro", "string"), ("rotacion", "int"), ("aplanar", "boolean"), ("dedos", "boolean"), ("brillo", "int"), ("contraste", "int"), ("creada", "bigint")):
        full = full.withColumn(c, F.lit(None).cast(t))
    manifest = sinks.backup_manifest(docs.withColumn("carpeta_id", F.coalesce("carpeta_id", F.lit("gone"))), full, folders, "pliego").first().manifest
    listed = json.loads(manifest)
    assert [d["id"] for d in listed["documentos"]] == ["d2", "d1"] and [p["id"] for p in listed["documentos"][1]["paginas"]] == ["p1", "p2"]
    blobs = [(n, b"x") for i in ("p1", "p3") for n in (f"paginas/{i}-original.jpg", f"paginas/{i}-pagina.jpg")] + [("paginas/p2-pagina.jpg", b"x")]
    archive = spark.createDataFrame([("a.zip", sinks.zip_bytes([("respaldo.json", manifest.encode()), *blobs]))], "path string, content binary")
    unpacked = files.entries(archive)
    f, d, p = files.restore(unpacked, "pliego")
    assert f.count() == 1 and {r.id: (r.carpeta_id, r.paginas) for r in d.collect()} == {"d1": ("f1", ["p1"]), "d2": (None, ["p3"])}
    assert {r.id for r in p.collect()} == {"p1", "p3"} and p.first().aplanar is True
    assert files.restore(unpacked, "other")[1].count() == 0


def test_backup_keeps_every_field_of_a_page(spark):
    """Marks, read text, corners, sizes and the rest come back as they were, as one manifest and as lines; numbers of versions don't matter."""
    marks = '[{"tipo":"resaltador","color":"verde","puntos":[[0.1,0.2],[0.5,0.2]]},{"tipo":"nota","texto":"¡Ojo!\\n{"}]'
    ocr = '{"idioma":"spa","texto":"Hola\\nmundo","lineas":[{"y0":1,"palabras":[]}]}'
    pages = spark.sql(f"""SELECT 'p1' AS id, 'd1' AS doc_id, 800 AS ancho, 600 AS alto, array(named_struct('x', 0.0D, 'y', 0.5D)) AS esquinas, 'bn' AS filtro, 90 AS rotacion, 700 AS procAncho, 500 AS procAlto,
        5L AS creada, r'{ocr}' AS ocr, 0.31D AS nitidez, false AS aplanar, true AS aplanada, CAST(NULL AS BOOLEAN) AS dedos, true AS sinDedos, 3 AS brillo, CAST(NULL AS INT) AS contraste, parse_json(r'{marks}') AS marcas,
        'portada' AS modo, named_struct('titulo', 'Tesis') AS portada, CAST(NULL AS STRUCT<cuando:BIGINT,lugar:INT>) AS papelera""")
    docs = spark.sql("SELECT 'd1' AS id, 'Uno' AS nombre, 1L AS creado, 2L AS modificado, 'f' AS carpeta_id, array('p1', 'gone') AS paginas, CAST(NULL AS BIGINT) AS papelera")
    folders = spark.sql("SELECT 'f' AS id, 'Carpeta' AS nombre, 9L AS creada")
    whole = sinks.backup_manifest(docs, pages, folders, "pliego").first().manifest
    lines = "\n".join(r.manifest for r in sinks.backup_lines(docs, pages, folders, "pliego").collect())
    for manifest in (whole, lines, whole.replace('"version":1', '"version":7')):
        names = [("respaldo.json", manifest.encode()), ("paginas/p1-original.jpg", b"o"), ("paginas/p1-pagina.jpg", b"p")]
        f, d, p = files.restore(spark.createDataFrame([("x", n, c) for n, c in names], files.ENTRIES), "pliego")
        r = p.select("*", *[F.to_json(c).alias(f"{c}_json") for c in ("marcas", "ocr", "portada")]).first()
        assert (r.ancho, r.alto, r.filtro, r.rotacion, r.procAncho, r.procAlto, r.creada, r.nitidez, r.modo) == (800, 600, "bn", 90, 700, 500, 5, 0.31, "portada")
        assert (r.aplanar, r.aplanada, r.dedos, r.sinDedos, r.brillo, r.contraste) == (False, True, True, True, 3, 0)
        assert [(c.x, c.y) for c in r.esquinas] == [(0.0, 0.5)] and (bytes(r.original_bytes), bytes(r.procesada_bytes)) == (b"o", b"p")
        assert (json.loads(r.marcas_json), json.loads(r.ocr_json), json.loads(r.portada_json)) == (json.loads(marks), json.loads(ocr), {"titulo": "Tesis"})
        assert [tuple(x) for x in d.select("id", "nombre", "creado", "modificado", "carpeta_id", "paginas").collect()] == [("d1", "Uno", 1, 2, "f", ["p1"])] and f.count() == 1


def test_settings(spark):
    got = one(spark, library.settings(lit('{"filtro":"bn","nube":"x"}'), {"filtro": "mejorada", "lado": "3000"}, ("nube",)))
    assert got == {"filtro": "bn", "lado": "3000"} and one(spark, library.settings(lit("no json"), {"a": "1"})) == {"a": "1"}


def test_machines(spark):
    m = capture.CodeFilter(3000)
    assert [t for t in (0, 1000, 2999, 3000, 5000, 6100) if m.step({"code": "x", "at": t})] == [0, 3000, 6100]
    m = capture.CodeFilter(3000)
    assert [bool(m.step({"code": c, "at": t, "shown": 500})) for c, t in (("a", 0), ("b", 400), ("b", 600), ("a", 1200), ("a", 2000), ("a", 4600), ("a", 4700), ("a", 8200))] == [True, False, True, True, False, False, True, True]
    rows = [("c", "a", 0), ("c", "a", 400), ("c", "b", 500), ("c", "a", 1000), ("d", "a", 1000), ("d", "a", 3999), ("d", "a", 4000), (None, "a", 5), (None, "a", 6)]
    df = spark.createDataFrame(rows, "camera string, code string, at long").repartition(3)
    want = {("c", "a", 0), ("c", "b", 500), ("c", "a", 1000), ("d", "a", 1000), ("d", "a", 4000), (None, "a", 5)}
    assert {tuple(r) for r in capture.accepted_codes_batch(df).collect()} == want


def test_stream_keeps_its_state(spark, tmp_path):
    source, schema = tmp_path / "in", "camera string, code string, at long"
    source.mkdir()
    q = capture.over_stream(spark.readStream.schema(schema).json(str(source)), "camera", capture.CodeFilter).writeStream.format("memory").queryName("codes").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for n, at in enumerate((0, 1000, 4000)):
            (source / f"{n}.json").write_text(json.dumps({"camera": "c", "code": "a", "at": at}) + "\n")
            q.processAllAvailable()
        assert sorted(r.at for r in spark.table("codes").collect()) == [0, 4000]
    finally:
        q.stop()


def test_registered_queries_have_sql():
    import __spark_entry__ as entry

    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    assert set(plans.queries()) == set(plans.oracle_sql()) and len(plans.queries()) >= 120


def test_books_covers_and_locks(spark):
    docs, pages, _ = store(spark)
    pages = pages.withColumns({"modo": F.lit(None).cast("string"), "creada": F.lit(1).cast("long"), "rotacion": F.lit(2)})
    half = lambda i: spark.createDataFrame([(i, None, f"half {i}", None, None, 5, 3)], pages.schema)
    d, p = commands.split_book(docs, pages, "p1", half("a"), half("b"), 9)
    assert shape(d, p)[0]["d1"] == ["p1", "b", "px", "p2"] and {r.id: r.rotacion for r in p.collect()}["p1"] == 0
    cover = spark.createDataFrame([("c", None, "cover", None, "portada", 7, 0)], pages.schema)
    d, p = commands.save_cover(docs, pages, "d1", cover, 9)
    assert shape(d, p)[0]["d1"][0] == "c"
    again = cover.withColumn("id", F.lit("c2")).withColumn("creada", F.lit(99).cast("long")).withColumn("texto", F.lit("new"))
    d, p = commands.save_cover(d, p, "d1", again, 10)
    row = p.where("id = 'c'").first()
    assert shape(d, p)[0]["d1"].count("c") == 1 and (row.creada, row.texto, row.doc_id) == (7, "new", "d1") and p.where("id = 'c2'").isEmpty()
    have = F.create_map(*map(F.lit, ("pin", "1", "espera", "5", "fallos", "3", "tema", "x")))
    assert one(spark, commands.lock_settings(have, pin="2")) == {"pin": "2", "espera": "5", "tema": "x"} and one(spark, commands.lock_settings(have, removed=True)) == {"tema": "x"}


def test_profiles():
    y = np.arange(400)
    profile = np.maximum(0, np.cos(2 * np.pi * y / 25))
    assert images.row_pitch(profile, 10, 60) == 25 and images.row_pitch(np.ones(50), 5, 20) is None
    assert np.diff(images.peaks(profile, 6, 0.5))[:14].tolist() == [25] * 14
    tracks = images.row_tracks([np.array([10, 35]), np.array([11, 36]), np.array([12, 37, 60])], 25)
    assert sorted(len(t) for t in tracks) == [1, 3, 3]
    assert images.straight_stroke(np.array([0, 5, 10, 5.2, 20, 5.1]), 2)[:, 1] == pytest.approx([5.1, 5.1]) and images.straight_stroke(np.array([0, 0, 5, 50, 10, 0]), 2) is None
    size, cards = images.cards_on_sheet((215.9, 279.4), 2)
    assert size == (2550, 3300) and cards[0][2:] == (1011, 638)


def test_encrypted_pdf(spark):
    from pliego.sources.encryption import Lock, _hash, cbc

    key, plain = bytes.fromhex("000102030405060708090a0b0c0d0e0f"), bytes.fromhex("00112233445566778899aabbccddeeff")
    assert cbc(key, bytes(16), plain).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    assert cbc(key + bytes.fromhex("101112131415161718191a1b1c1d1e1f"), bytes(16), plain).hex() == "8ea2b7ca516745bfeafc49904b496089"
    lock = Lock("clave")
    opened = spark.createDataFrame([(lock(b"page one"), lock.key)], "data binary, key binary").select(F.aes_decrypt("data", "key", F.lit("CBC"))).first()[0]
    assert bytes(opened) == b"page one"
    field = lambda name: bytes.fromhex(lock.dictionary.split(f"/{name} <")[1].split(">")[0])
    assert _hash(b"clave", field("U")[32:40]) == field("U")[:32] and _hash(b"clave", field("O")[32:40], field("U")) == field("O")[:32]
    assert _hash(b"other", field("U")[32:40]) != field("U")[:32]
    bits = {"kind": "bits", "bytes": bytes(2), "width": 8, "height": 2}
    pdf = sinks.pdf_bytes("Secreto", [bits], password="clave")
    assert b"/Encrypt" in pdf and b"/V 5 /R 6" in pdf and "Secreto".encode("utf-16-be").hex().upper().encode() not in pdf


def test_images_over_rows(spark):
    rows = [(k, {"width": 360, "height": 480, "data": page(k).tobytes()}) for k in (1, 2)]
    df = spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>")
    turned = images.on_images(df, lambda img, row: images.turn(img, 1) if row["id"] == 1 else None).collect()
    assert [(r.id, r.image.width, r.image.height) for r in turned] == [(1, 480, 360)]
    got = images.measured(df, "id int, sharp double", lambda img, row: {"sharp": images.sharpness(img)}).collect()
    assert all(r.sharp > 0.28 for r in got)
    assert images.process(page(1), {"filtro": "bn", "rotacion": 1})[0].shape == (360, 480, 4)


def test_pages_from_pieces_and_files_per_document(spark, tmp_path):
    pieces = [(k, t, x, y, 20.0, 60.0) for k in (1, 2) for t, x, y in (("mundo", 160.0, 100.0), ("Hola ", 100.0, 101.0), ("Fin", 100.0, 160.0))]
    df = spark.createDataFrame(pieces, "page_id int, str string, x double, y double, h double, w double")
    read = layout.read_chunks(df).orderBy("page_id").collect()
    assert [r.texto for r in read] == ["Hola mundo\n\nFin"] * 2 and len(read[0].lineas) == 2
    pages = spark.createDataFrame([("d", 1, "dos"), ("d", 0, "uno"), ("e", 0, "tres")], "doc string, pos int, texto string")
    made = sinks.files_per_document(pages, "doc", lambda rows: (f"{rows[0]['doc']}.txt", "\n".join(r["texto"] for r in rows).encode()))
    assert {r.name: bytes(r.content).decode() for r in made.collect()} == {"d.txt": "uno\ndos", "e.txt": "tres"}
    (tmp_path / "a.zip").write_bytes(sinks.zip_bytes([("x", b"1")]))
    assert [(r.name, bytes(r.content)) for r in files.entries(files.files(spark, str(tmp_path))).collect()] == [("x", b"1")]


def test_filters_of_pages(spark):
    schema = "id string, filtro string, nitidez double, papelera long, modo string, no_repetida boolean, repetida string, marcas array<struct<tipo:string>>"
    p = spark.createDataFrame([("a", "mejorada", 0.2, None, None, None, "x", [("resaltador",)]), ("b", "dibujo", 0.2, None, "portada", None, None, None), ("c", "bn", None, 5, None, True, "gone", [("nota",)])], schema)
    pick = lambda c: [r.id for r in p.where(c).orderBy("id").collect()]
    assert pick(library.blurry(p)) == ["a"] and pick(library.comparable(p)) == ["a"] and pick(library.has_highlights(p["marcas"])) == ["a"]
    assert pick(library.still_repeated(p["repetida"], F.array(F.lit("x"), F.lit("y")))) == ["a"]
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    assert one(spark, library.convex(square)) and one(spark, highlights.nearest_corner(square, F.lit(0.9), F.lit(0.2))) == 1
    sizes = spark.createDataFrame([("d", 10, 20), ("d", 20, 10), ("e", 20, 10)], "doc_id string, ancho int, alto int")
    assert {r.doc_id: r.upright for r in library.sheet_orientation(sizes).collect()} == {"d": True, "e": False}
    covers = spark.createDataFrame([("t", {"tema": "", "clase": "Mate"}, {"tema": "x", "clase": ""}, None)], "id string, clase struct<tema:string,clase:string>, perfil struct<tema:string,clase:string>, actual struct<tema:string,clase:string>")
    assert tuple(library.cover_defaults(covers, ["tema", "clase"]).first().portada) == ("x", "Mate")
    assert one(spark, highlights.normal_signature(F.array(F.array(*map(F.lit, (10.0, 10.0, 60.0, 30.0)))), F.lit(2.0))).aspect == pytest.approx(24 / 54)


def test_colours_and_frames(spark):
    h = one(spark, arrays.hue(lit(200), lit(100), lit(100)))
    assert (h.hue, h.saturation) == (0.0, 0.5) and one(spark, arrays.hue(lit(9), lit(9), lit(9))).hue == 0.0 and one(spark, arrays.hue(lit(255), lit(0), lit(128))).hue == pytest.approx(329.88, abs=0.01)
    ink = one(spark, arrays.ink_of_hue(lit(120.0)))
    assert (ink.r, ink.g, ink.b) == (pytest.approx(15.3), pytest.approx(188.7), pytest.approx(15.3))
    assert [one(spark, codes.pin_format(lit(p))) for p in ("1234", "123", "1234567890123", "12a4", "1234\n", None)] == [True, False, False, False, False, False]
    frame = np.zeros((80, 60, 4), np.uint8)
    frame[:10, :10, :3] = 255
    s = images.frame_signature(frame)
    assert s.shape == (48,) and s.sum() == pytest.approx(1) and s.argmax() == 0 and images.frame_signature(np.zeros((8, 8, 4))).sum() == 0
    assert images.light_base(np.zeros((2800, 1400, 4), np.uint8)).shape[:2] == (1400, 700)


def test_book_pages_and_blur(spark):
    book = np.full((300, 440, 4), 235, np.uint8)
    rng = np.random.default_rng(2)
    for y in range(30, 270, 9):
        for a, b in ((30, 200), (240, 410)):
            book[y : y + 4, a:b, :3] = np.where(rng.random(b - a) < 0.5, 40, 235)[:, None]
    corners = [0.0, 0.0, 439.0, 0.0, 439.0, 299.0, 0.0, 299.0]
    sheet = book.copy()
    sheet[30:270, 195:245, :3] = np.where(rng.random((240, 50)) < 0.5, 40, 235)[..., None]
    rows = [(k, {"width": 440, "height": 300, "data": i.tobytes()}, corners) for k, i in enumerate((book, sheet))]
    out = images.book_pages(spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>, corners array<double>")).collect()
    assert [(r.id, r.side) for r in sorted(out, key=lambda r: (r.id, r.side or ""))] == [(0, "left"), (0, "right"), (1, None)]
    left, right = (next(r for r in out if r.side == side).corners for side in ("left", "right"))
    assert left[2] == pytest.approx(right[0]) == pytest.approx(220, abs=15) and right[2] == 439
    soft = book.copy()
    for _ in range(6):
        soft[1:-1, 1:-1] = ((soft[:-2, 1:-1].astype(int) + soft[2:, 1:-1] + soft[1:-1, :-2] + soft[1:-1, 2:] + soft[1:-1, 1:-1]) // 5).astype(np.uint8)
    q = np.array(corners).reshape(4, 2)
    assert images.blurry_sheet(soft, q) and not images.blurry_sheet(np.full((50, 50, 4), 200, np.uint8), np.array([[0, 0], [49, 0], [49, 49], [0, 49]], float))


def test_sheets():
    sheets = sinks.sheets_of([(600, 800), (800, 600)], "carta", 1)
    assert [(w, h) for w, h, _ in sheets] == [(612, 792), (792, 612)] and sheets[0][2][0][3] == pytest.approx(0.99)
    assert sinks.sheets_of([(396, 198)], "foto", 1) == [(792.0, 396.0, [(0, 0.0, 0.0, 2.0)])]
    (w, h, spots), more = sinks.sheets_of([(300, 400)] * 3, "carta", 2)
    assert (w, h, len(spots), len(more[2])) == (792, 612, 2, 1)
    cell = (792 - 36 - 14) / 2
    assert spots[0][3] == pytest.approx(min(cell / 300, 576 / 400)) and spots[1][1] - spots[0][1] == pytest.approx(cell + 14) and spots[0][2] == pytest.approx(18 + (576 - 400 * spots[0][3]) / 2)
    w, h, spots = sinks.sheets_of([(400, 300)] * 4, "a4", 4)[0]
    assert (w, h) == (841.89, 595.28) and spots[0][2] > spots[2][2] and spots[0][1] < spots[1][1]


def test_photos_are_turned_and_shrunk(spark, tmp_path):
    import struct

    def exif(order, value):
        e = "<" if order == b"II" else ">"
        tiff = order + struct.pack(f"{e}HIH", 42, 8, 2) + struct.pack(f"{e}HHIHH", 0x010F, 3, 1, 9, 0) + struct.pack(f"{e}HHIHH", 0x0112, 3, 1, value, 0) + bytes(4)
        return b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff

    for order in (b"II", b"MM"):
        assert [files.exif_orientation(b"\xff\xd8\xff\xe0\x00\x04ab" + exif(order, v) + b"\xff\xda") for v in (1, 6, 8, 9)] == [1, 6, 8, 1]
    assert files.exif_orientation(b"\xff\xd8\xff\xda") == files.exif_orientation(b"") == 1
    img = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    want = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert {k: files.upright(img, k)[..., 0].tolist() for k in want} == want
    picture = np.random.default_rng(0).integers(0, 256, (40, 60, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(sinks.png_bytes(picture))
    (tmp_path / "b.png").write_bytes(sinks.png_bytes(picture[..., 0] > 127))
    got = {r.path.rsplit("/", 1)[1]: r.image for r in files.photos(spark, str(tmp_path), side=4000).collect()}
    a = np.frombuffer(bytes(got["a.png"].data), np.uint8).reshape(40, 60, 4)
    assert (a[..., :3] == picture).all() and (got["b.png"].width, got["b.png"].height) == (60, 40)
    b = np.frombuffer(bytes(got["b.png"].data), np.uint8).reshape(40, 60, 4)
    assert ((b[..., 0] > 127) == (picture[..., 0] > 127)).all()
    assert max(files.photos(spark, str(tmp_path / "a.png"), side=30).first().image[:2]) == 30


def test_notes_and_stillness(spark):
    assert text.wrap_note("uno dos tres\n\ncuatrocientos", 7, len) == ["uno dos", "tres", "", "cuatroc", "ientos"]
    assert text.wrap_note("a abcdefghij b", 4, len) == ["a", "abcd", "efgh", "ij b"] and text.wrap_note("", 4, len) == [""]
    rows = [("a", 0, t, m) for t, m in ((70, 30), (140, 5), (210, 5), (280, 5), (360, 5))] + [("b", 0, t, 90) for t in range(0, 1600, 70)] + [("c", 100, 150, 12), ("c", 100, 1000, 12), ("c", 100, 1220, 12)]
    got = {r.shot: r.taken for r in capture.stillness(spark.createDataFrame(rows, "shot string, pressed long, at long, motion int"), 10).collect()}
    assert got == {"a": 360, "b": 1500, "c": 1220}


def test_log_of_changes(spark, tmp_path):
    root, made = str(tmp_path / "log"), lambda rows: spark.createDataFrame(rows, "id string, n int, items array<int>")
    commands.append_changes(root, "docs", made([("a", 1, [1]), ("b", 2, None), ("c", 3, [])]))
    commands.append_changes(root, "docs", made([("b", 20, [2]), ("b", 21, [3])]).coalesce(1), made([("c", 0, None)]))
    commands.append_changes(root, "docs", made([("d", None, None)]))
    assert sorted(tuple(r) for r in commands.read_changes(spark, root, "docs").collect()) == [("a", 1, [1]), ("b", 21, [3]), ("d", None, None)]


def test_files_are_encrypted_by_spark(spark):
    """A lock made once for all files; each file's image streams, encrypted as rows, open under its key to what went in."""
    lock = Lock("clave")
    rows = [("a", 0, "bits", bytes(range(20)), 16, 10), ("a", 1, "jpeg", b"\xff\xd8 no picture " * 99, 30, 20), ("b", 0, "bits", bytes(2), 8, 2)]
    sealed = sinks.sealed_images(spark.createDataFrame(rows, "doc string, pos int, kind string, bytes binary, width int, height int"), lock)
    made = {r.doc: bytes(r.content) for r in sinks.files_per_document(sealed, "doc", lambda images: (f"{images[0]['doc']}.pdf", sinks.pdf_bytes("Uno", images, lock=lock))).collect()}
    assert set(made) == {"a", "b"} and all(lock.dictionary.encode() in pdf for pdf in made.values())
    streams = [p.split(b">>\nstream\n", 1)[1].split(b"\nendstream")[0] for p in made["a"].split(b"/Subtype /Image")[1:]]
    opened = [bytes(r[0]) for r in spark.createDataFrame([(s, lock.key) for s in streams], "data binary, key binary").select(F.aes_decrypt("data", "key", F.lit("CBC"))).collect()]
    assert sorted([zlib.decompress(opened[0]), opened[1]] if opened[0][:1] == b"x" else [opened[0], zlib.decompress(opened[1])]) == sorted([rows[0][3], rows[1][3]])


def test_text_of_pdf_files(spark):
    """Operators, font tables and object streams give words in their places; nothing comes from pictures or from what is no PDF."""
    bits = {"kind": "bits", "bytes": sinks.pack_bits(np.full((100, 100), 255)), "width": 100, "height": 100}
    table = b"/CIDInit begincmap 1 beginbfchar <0001> <00F1> endbfchar 1 beginbfrange <0002> <0004> <0061> endbfrange endcmap"
    content = zlib.compress(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 14 TL 50 300 Td (uno \\050x\\051) Tj T* [(do) -2000 (s)] TJ ET Q BT /F2 8 Tf 1 0 0 1 20 40 Tm <000200010004> Tj ET")
    first, stream = len(b"5 0 "), b"5 0 << /Type /Page /Parent 2 0 R /Contents 8 0 R >>"
    parts = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [5 0 R] /Count 1 /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>",
        3: b"<< /Type /Font /Subtype /TrueType /FirstChar 100 /Widths [500 500 500 500 500 500 500 500 500 500 500 500] >>",
        4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>",
        7: b"<< /Type /ObjStm /N 1 /First %d /Length %d >>\nstream\n" % (first, len(stream)) + stream + b"\nendstream",
        8: b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(content) + content + b"\nendstream",
        9: b"<< /Length %d >>\nstream\n" % len(table) + table + b"\nendstream",
    }
    made = b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n" % k + v + b"\nendobj\n" for k, v in parts.items()) + b"trailer << /Root 1 0 R >>"
    rows = [("own", sinks.pdf_bytes("Uno", [bits], "foto")), ("made", made), ("none", b"no pdf"), ("locked", sinks.pdf_bytes("x", [bits], lock=Lock("k"))), ("empty", b"")]
    got = pdf.text_pieces(spark.createDataFrame(rows, "path string, content binary"))
    by = {}
    for r in got.collect():
        by.setdefault((r.path, r.page), []).append(r)
    assert set(by) == {("made", 1)}
    one_, two, three, four = by["made", 1]
    assert (one_.str, one_.x, one_.y, one_.h) == ("uno (x)", 100, 192, 20) and (two.str, three.str, four.str) == ("do", "s", "añc")
    assert two.y == 220 and three.x == pytest.approx(two.x + two.w + 40) and two.w == pytest.approx(20 * (0.5 + 0.5)) and (four.x, four.y, four.h) == (20, 752, 8)
    pages = got.selectExpr("concat(path, ' ', page) AS page_id", "str", "x", "y", "h", "w")
    texts = {r.page_id: r.texto for r in layout.read_chunks(pages).collect()}
    assert set(texts) == {"made 1"} and "uno (x)" in texts["made 1"]


def test_store_opens_with_declared_tables(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    made = commands.open_store(spark, root)
    assert {t: df.count() for t, df in made.items()} == {"docs": 0, "pages": 0, "folders": 0, "settings": 0} and "paginas" in made["docs"].columns
    commands.write_snapshot(root, "one", folders=spark.createDataFrame([("f", "Uno", 1)], commands.TABLES["folders"]))
    opened = commands.open_store(spark, root)
    assert opened["folders"].first().nombre == "Uno" and opened["docs"].count() == 0


def test_ready_photos_and_marked_pages(spark):
    img = np.full((400, 300, 4), 70, np.uint8)
    img[60:340, 60:240, :3] = 230
    plain = np.full((50, 40, 4), 200, np.uint8)
    rows = [(k, {"width": i.shape[1], "height": i.shape[0], "data": i.tobytes()}) for k, i in enumerate((img, plain))]
    got = {r.id: r for r in images.ready_photos(spark.createDataFrame(rows, "id int, image struct<width:int,height:int,data:binary>"), side=200).collect()}
    assert (got[0].preview.width, got[0].preview.height) == (150, 200) and np.abs(np.array(got[0].corners).reshape(4, 2) * [300, 400] - [[60, 60], [240, 60], [240, 340], [60, 340]]).max() < 6
    assert got[0].blurry is False and got[1].corners is None and got[1].blurry is None
    page_ = np.full((100, 200, 4), 240, np.uint8)
    pen, marker = {"points": [0.1, 0.5, 0.9, 0.5], "thickness": 0.02, "colour": [200, 0, 0], "highlighter": False}, {"points": [0.5, 0.2], "thickness": 0.1, "colour": [255, 255, 0], "highlighter": True}
    out = images.with_strokes(page_, [pen, marker])
    assert out[50, 100, :3].tolist() == [200, 0, 0] and out[20, 100, :3].tolist() == [240, 240, 0] and out[80, 100, :3].tolist() == [240, 240, 240] and out[50, 10, :3].tolist() == [240, 240, 240]
    strokes = "array<struct<points:array<double>,thickness:double,colour:array<int>,highlighter:boolean>>"
    data = {"width": 200, "height": 100, "data": page_.tobytes()}
    df = spark.createDataFrame([(1, "bn", data, None), (2, "bn", data, [pen]), (3, "gris", data, [])], f"id int, filtro string, image struct<width:int,height:int,data:binary>, strokes {strokes}")
    made = {r.id: bytes(r.png) for r in sinks.page_pngs(df).collect()}
    assert [made[k][24:26] for k in (1, 2, 3)] == [b"\x01\x00", b"\x08\x02", b"\x08\x02"] and all(m[:4] == b"\x89PNG" for m in made.values())


def test_sheets_on_light_uneven_and_cluttered_desks():
    """Corners within 2 % of the diagonal where the desk is nearly as light as the sheet, gets lighter to one side, or is full of things; lines are those drawn."""
    for kind in ("light", "uneven", "clutter"):
        for seed in range(3):
            rng, h, w = np.random.default_rng(seed), 400, 300
            q = np.array([[60, 70], [240, 60], [250, 330], [50, 340]], float) + rng.uniform(-15, 15, (4, 2))
            y, x = np.mgrid[:h, :w]
            inside = np.all([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= 0 for a, b in zip(q, np.roll(q, -1, axis=0), strict=True)], axis=0)
            desk = np.full((h, w), 205.0) if kind == "light" else 90 + 120.0 * x / w if kind == "uneven" else np.full((h, w), 110.0)
            for cx, cy, a, b, v in rng.integers([0, 0, 8, 8, 30], [w, h, 40, 40, 240], (14, 5)) if kind == "clutter" else ():
                desk[max(0, cy - b) : cy + b, max(0, cx - a) : cx + a] = v
            g = np.where(inside, 240, desk) + rng.normal(0, 2, (h, w))
            for r in range(100, 310, 12):
                g[r : r + 4, 90:210] = np.where(inside[r : r + 4, 90:210] & (rng.random((4, 120)) < 0.5), 70, g[r : r + 4, 90:210])
            img = np.dstack([g, g, g, np.full((h, w), 255)]).clip(0, 255).astype(np.uint8)
            found = images.find_sheet(img)
            assert found is not None and np.abs(found[0] * [w, h] - q).max() < 0.02 * 500, (kind, seed)
    plain = np.full((120, 160), 100.0)
    plain[30:] += 60
    plain[:, 100:] += 50
    lines = images.edge_lines(plain, 2)
    assert sorted(np.round(np.degrees(lines[:, 0])).tolist()) == [0, 90] and np.abs(np.sort(np.abs(lines[:, 1])) - [19.5, 30.5]).max() <= 1


def test_words_of_a_tree_are_read_once(spark, tmp_path):
    """Each step over a line's words stands once in the plan, and what is shuffled is text, not its words."""
    rows = [(1, 0, "user", "Hola mundo entero"), (1, 1, "user", ""), (2, 0, "user", "— =="), (3, 0, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = plans.queries()["read_pages"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(layout.WELL_FORMED) == 1
    assert "split(" not in plan[plan.index("Aggregate") :]
    assert [r.conv_id for r in df.collect()] == [1]
