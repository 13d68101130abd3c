"""Ordered arrays as the library edits them: nothing loses its duplicates, and places are clamped, not padded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def without(items: Column, ids: Column) -> Column:
    return F.filter(items, lambda x: ~F.array_contains(ids, x))


def only(items: Column, ids: Column) -> Column:
    return F.filter(items, lambda x: F.array_contains(ids, x))


def insert_at(items: Column, item: Column, index: Column) -> Column:
    """item at index (from 0), clamped to the array."""
    return F.array_insert(items, F.greatest(F.lit(0), F.least(index, F.size(items))).cast("int") + 1, item)


def insert_after(items: Column, item: Column, anchor: Column) -> Column:
    """item after anchor, at the end where there is no anchor."""
    at = F.array_position(items, anchor)
    return insert_at(items, item, F.when(at > 0, at).otherwise(F.size(items)))


def reorder(items: Column, order: Column) -> Column:
    """The new order, of what is there, then what it doesn't name."""
    return F.concat(only(order, items), without(items, order))


def swap(items: Column, i: Column, j: Column) -> Column:
    """The items at i and j (from 0) exchanged; unchanged where either is outside."""
    inside = (i >= 0) & (j >= 0) & (i < F.size(items)) & (j < F.size(items))
    moved = F.transform(items, lambda x, k: F.when(k == i, F.get(items, j)).when(k == j, F.get(items, i)).otherwise(x))
    return F.when(inside, moved).otherwise(items)


def suffix(items: Column, n: Column) -> Column:
    """From the n-th item (from 1) on."""
    return F.slice(items, n, F.greatest(F.size(items), F.lit(1)))


def prefix(items: Column, n: Column) -> Column:
    """Before the n-th item (from 1)."""
    return F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0)))


def recent(items: Column, most: int) -> Column:
    """The last items, as many as a bounded history keeps."""
    return F.slice(items, F.greatest(F.size(items) - most + 1, F.lit(1)), F.lit(most))


def ranges(numbers: Column) -> Column:
    """Sorted numbers as ranges: 2–4, 7."""
    step = lambda out, n: F.when((F.size(out) > 0) & (F.element_at(out, -1)["b"] == n - 1), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["a"].alias("a"), n.alias("b"))))).otherwise(F.concat(out, F.array(F.struct(n.alias("a"), n.alias("b")))))
    runs = F.aggregate(F.sort_array(F.array_distinct(numbers)).cast("array<bigint>"), F.array().cast("array<struct<a:bigint,b:bigint>>"), lambda out, n: F.when(F.size(out) == 0, F.array(F.struct(n.alias("a"), n.alias("b")))).otherwise(step(out, n)))
    return F.array_join(F.transform(runs, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("–", r["a"].cast("string"), r["b"].cast("string")))), ", ")


def exact_percentile(values: Column, p: float) -> Column:
    """The sorted values' item floor(n p), not interpolated."""
    s = F.sort_array(values)
    return F.get(s, F.least(F.floor(F.size(s) * p), F.size(s) - 1).cast("int"))


def upper_median(values: Column) -> Column:
    """The upper one of the middle; 0 for none."""
    return F.coalesce(F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length))).otherwise(0.0)
    x, y = px - ax - t * dx, py - ay - t * dy
    return F.sqrt(x * x + y * y)  # as SQL has it; hypot rounds otherwise, which decides what lies at a reach exactly


def light_curve(value: Column, brightness: float, contrast: float) -> Column:
    """A byte under brightness (a power that fixes the ends) and contrast (about the middle), both from -50 to 50."""
    x = F.pow(value / 255.0, F.lit(2.0 ** (-brightness / 50)))
    x = (x - 0.5) * (2.0 ** (contrast / 50)) + 0.5
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(255 * x + 0.5))).cast("int")


def hue(r: Column, g: Column, b: Column) -> Column:
    """struct(hue, saturation) of a colour: hue in degrees, 0 for greys."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (high - low).cast("double")
    sixth = F.when(high == r, (g - b) / span).when(high == g, (b - r) / span + 2).otherwise((r - g) / span + 4)
    grey = span < 1e-6
    return F.struct(F.when(grey, 0.0).otherwise(F.pmod(sixth * 60, F.lit(360.0))).alias("hue"), F.when(grey, 0.0).otherwise(span / high).alias("saturation"))


#: How saturated and how light ink of a hue is (fixed values).
INK_SATURATION, INK_LIGHTNESS = 0.85, 0.4


def ink_of_hue(degrees: Column) -> Column:
    """struct(r, g, b), 0 to 255: a dark, saturated colour of that hue. A channel falls off with its distance from the hue around the circle."""
    chroma = (1 - abs(2 * INK_LIGHTNESS - 1)) * INK_SATURATION
    base = INK_LIGHTNESS - chroma / 2

    def channel(peak: int) -> Column:
        far = F.abs(F.pmod(degrees - peak + 180, F.lit(360.0)) - 180) / 60
        return (F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - far)) * chroma + base) * 255

    return F.struct(channel(0).alias("r"), channel(120).alias("g"), channel(240).alias("b"))
