"""Marks on pages: the text under highlighter strokes, hits, rotation, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays

#: The highlighter's colours and their names (fixed values).
COLOURS = {"#ffe84a": "amarillo", "#a8f07c": "verde", "#ffa0d8": "rosado", "#96dcff": "celeste"}


#: Side of the squares of a page, in pixels, in which what is near each other is looked for.
CELL = 64.0


def _squares(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, cell: float) -> DataFrame:
    """rows, once for each square (_x, _y) that a box meets."""
    span = lambda low, high: F.explode(F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long")))
    return rows.withColumn("_x", span(x0, x1)).withColumn("_y", span(y0, y1))


def _met(squares: DataFrame, others: DataFrame) -> DataFrame:
    """Rows of the same square of a page. Spark takes squares for no more than the rows they come from, and would send all of them through the driver to each executor: so they are sorted."""
    return squares.hint("merge").join(others, ["page_id", "_x", "_y"])


def legs(strokes: DataFrame, points: str = "points") -> DataFrame:
    """strokes, once for each leg (ax, ay) to (bx, by) in pixels, without their points; a stroke of one point is a leg of none."""
    n = F.floor(F.size(points) / 2).cast("int")
    each = strokes.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))))
    at = lambda k, size: F.get(points, k) * F.col(size)
    k, b = F.col("_k"), F.least(F.col("_k") + 1, n - 1)
    return each.withColumns({"ax": at(2 * k, "width"), "ay": at(2 * k + 1, "height"), "bx": at(2 * b, "width"), "by": at(2 * b + 1, "height")}).drop(points, "_k")


def leg_squares(found: DataFrame, reach: Column, cell: float = CELL) -> DataFrame:
    """Legs, once for each square within reach: of the leg's box those whose centre is near enough."""
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    out = _squares(found, F.least(a[0], b[0]) - reach, F.least(a[1], b[1]) - reach, F.greatest(a[0], b[0]) + reach, F.greatest(a[1], b[1]) + reach, cell)
    return out.where(arrays.segment_distance((F.col("_x") + 0.5) * cell, (F.col("_y") + 0.5) * cell, *a, *b) <= reach + 0.75 * cell)


def touching(strokes: DataFrame, words: DataFrame, cell: float = CELL) -> DataFrame:
    """(page_id, line, word, stroke, color, t): each word with the first stroke that touches it (see highlighted).

    Strokes cover the squares of their page that they reach, a word those within its own reach; they meet by page and square, so a page with very many of either is many
    tasks' work, and only what meets is measured.
    """
    w = words.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2, "half": (F.col("y1") - F.col("y0")) / 2})
    own, wide = 0.9 * F.col("half"), F.col("thickness") * F.col("width") / 2
    w = _squares(w, F.col("cx") - own, F.col("cy") - own, F.col("cx") + own, F.col("cy") + own, cell)
    parts = legs(strokes.select("page_id", "stroke", "color", "thickness", "points", "width", "height").withColumn("wide", wide))
    met = _met(leg_squares(parts.drop("thickness", "width", "height"), F.col("wide"), cell), w)
    touched = met.where(arrays.segment_distance(F.col("cx"), F.col("cy"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= F.greatest(F.col("wide"), own))
    return touched.groupBy("page_id", "line", "word").agg(F.min(F.struct("stroke", "color", "t")).alias("s")).select("page_id", "line", "word", "s.*")


def highlighted(strokes: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, part, color, text): the text under highlighters, in the page's order.

    strokes (page_id, stroke, color, thickness, points, width, height), in the order they were drawn; words (page_id, line, word, t,
    x0, y0, x1, y1) in the page's pixels. A word counts if its centre lies in the stroke, and goes to the first stroke that touches it;
    a stroke that goes on at the next line in the same colour is the same part; hyphenated words are made whole.
    """
    first = touching(strokes, words)
    runs = first.groupBy("page_id", "stroke", "color").agg(F.sort_array(F.collect_list(F.struct("line", "word", "t"))).alias("words"))
    order = Window.partitionBy("page_id").orderBy(F.col("words")[0]["line"], F.col("words")[0]["word"])
    before = lambda c: F.lag(c).over(order)
    goes_on = (before("color") == F.col("color")) & (F.col("words")[0]["line"] == before(F.element_at("words", -1)["line"]) + 1)
    parts = runs.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("_new").over(order))
    joined = parts.groupBy("page_id", "part", "color").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("words")[0]["line"].alias("l"), F.col("words")[0]["word"].alias("w"), "words"))), lambda x: x["words"])).alias("words"))

    def add(said: Column, w: Column) -> Column:
        cut = (w["line"] != said["line"]) & F.rlike(said["text"], F.lit(r"\p{L}[-‐]$")) & F.rlike(w["t"], F.lit(r"^\p{Ll}"))
        text = F.when(said["text"] == "", w["t"]).when(cut, F.concat(F.substr(said["text"], F.lit(1), F.length(said["text"]) - 1), w["t"])).otherwise(F.concat_ws(" ", said["text"], w["t"]))
        return F.struct(w["line"].cast("int").alias("line"), text.alias("text"))

    text = F.aggregate("words", F.struct(F.lit(-1).alias("line"), F.lit("").alias("text")), add, lambda s: s["text"])
    return joined.select("page_id", "part", "color", text.alias("text"))


def mark_at(marks: DataFrame, points: DataFrame, margin: float = 0.0) -> DataFrame:
    """(point_id, mark): the topmost mark at each point. marks (page_id, mark, kind, box struct(x, y, w, h), thickness, points, width, height); points (page_id, point_id, x, y)."""
    box = F.col("kind").isin("nota", "firma")
    spots = points.select("page_id", "point_id", "x", "y", F.floor(F.col("x") / CELL).cast("long").alias("_x"), F.floor(F.col("y") / CELL).cast("long").alias("_y"))
    edges = [F.col("box.x") - margin, F.col("box.y") - margin, F.col("box.x") + F.col("box.w") + margin, F.col("box.y") + F.col("box.h") + margin]
    in_box = _met(_squares(marks.where(box).select("page_id", "mark", "box"), *edges, CELL), spots)
    in_box = in_box.where(F.col("x").between(edges[0], edges[2]) & F.col("y").between(edges[1], edges[3]))
    lines = marks.where(~F.coalesce(box, F.lit(False))).select("page_id", "mark", "points", "width", "height", (F.col("thickness") * F.col("width") / 2 + margin).alias("wide"))
    near = _met(leg_squares(legs(lines).drop("width", "height"), F.col("wide")), spots)
    near = near.where(arrays.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= F.col("wide"))
    return in_box.select("point_id", "mark").unionByName(near.select("point_id", "mark")).groupBy("point_id").agg(F.max("mark").alias("mark"))


def nearest_corner(corners: Column, x: Column, y: Column, reach: float = 44.0) -> Column:
    """The number (from 0) of the nearest corner within reach, else null."""
    far = F.transform(corners, lambda c: F.hypot(c["x"] - x, c["y"] - y))
    return F.when(F.array_min(far) <= reach, F.array_position(far, F.array_min(far)).cast("int") - 1)


def turn_points(points: Column) -> Column:
    """A quarter turn of fractions x, y, x, y, …"""
    return F.transform(points, lambda v, i: F.when(i % 2 == 0, 1 - F.get(points, i + 1)).otherwise(F.get(points, i - 1)))


def turn_strokes(strokes: DataFrame, turns: int) -> DataFrame:
    """strokes (points, thickness, width, height) after quarter turns: what was the width is the height, and sizes in pixels stay."""
    for _ in range(turns % 4):
        strokes = strokes.select(*[c for c in strokes.columns if c not in ("points", "thickness", "width", "height")], turn_points(F.col("points")).alias("points"), (F.col("thickness") * F.col("width") / F.col("height")).alias("thickness"), F.col("height").alias("width"), F.col("width").alias("height"))
    return strokes


def bounding_box(points: Column) -> Column:
    pick = lambda k: F.filter(points, lambda v, i: i % 2 == k)
    return F.struct(F.array_min(pick(0)).alias("x0"), F.array_min(pick(1)).alias("y0"), F.array_max(pick(0)).alias("x1"), F.array_max(pick(1)).alias("y1"))


def normal_signature(strokes: Column, thickness: Column) -> Column:
    """struct(strokes, aspect, thickness) of a drawing, cropped and in fractions of its own box; null for next to nothing."""
    box = bounding_box(F.flatten(strokes))
    x0, y0, w, h = box["x0"] - thickness, box["y0"] - thickness, box["x1"] - box["x0"] + 2 * thickness, box["y1"] - box["y0"] + 2 * thickness
    part = lambda v: F.floor(v * 10_000 + 0.5) / 10_000
    moved = F.transform(strokes, lambda s: F.transform(s, lambda v, i: part(F.when(i % 2 == 0, (v - x0) / w).otherwise((v - y0) / h))))
    enough = (F.size(F.flatten(strokes)) >= 4) & ((w >= 8) | (h >= 8))
    return F.when(enough, F.struct(moved.alias("strokes"), (h / w).alias("aspect"), (thickness / w).alias("thickness")))


def colours(parts: DataFrame, key: str, colour: str) -> DataFrame:
    """For each key how many highlighted parts it has and in how many colours."""
    return parts.groupBy(key).agg(F.count("*").alias("parts"), F.count_distinct(colour).alias("colours"))
