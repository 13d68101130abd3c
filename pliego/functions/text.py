"""Text functions over columns: folding, all-terms search, snippets, names, reading order."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as the library understands it, which is wider than that of Java's or RE2's \s.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


#: Hangul syllables, first and last, and of how many vowels and final letters (none included) each first letter has one (fixed values).
HANGUL, VOWELS, FINALS = "가힣", 21, 28


@cache
def fold_tables() -> tuple[str, str]:
    """Characters that fold to one other, then those that fold to nothing; and what the first fold to. Hangul syllables, which fold to several letters, aren't among them.

    A character folds by itself: its canonical decomposition without marks, in lower case. Those from U+10000 on are what they are.
    """
    pairs, marks = [], []
    for c in map(chr, range(0x10000)):
        if not 0xD800 <= ord(c) < 0xE000 and not HANGUL[0] <= c <= HANGUL[1]:
            bare = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M")).lower()
            if not bare:
                marks.append(c)
            elif bare != c:
                pairs.append((c, bare))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


@cache
def _jamo() -> str:
    """The letters of each Hangul syllable, in the syllables' order, parted by spaces."""
    return " ".join(unicodedata.normalize("NFD", chr(c)) for c in range(ord(HANGUL[0]), ord(HANGUL[1]) + 1))


def _is_hangul(c: Column) -> Column:
    return F.ascii(c).between(ord(HANGUL[0]), ord(HANGUL[1]))


def fold(text: Column) -> Column:
    """Lower case without accents or combining marks, character by character; what has no accent, like ß, stays."""
    flat = F.translate(text, *fold_tables())
    # Taken apart next to syllables only; the table of their letters is a constant.
    pieces = F.split(flat, f"(?<=[{HANGUL[0]}-{HANGUL[1]}])|(?=[{HANGUL[0]}-{HANGUL[1]}])")
    letters = lambda c: F.get(F.split(F.lit(_jamo()), " "), F.ascii(c) - ord(HANGUL[0]))
    apart = F.array_join(F.transform(pieces, lambda c: F.when(_is_hangul(c), letters(c)).otherwise(c)), "")
    return F.when(F.rlike(text, F.lit(f"[{HANGUL[0]}-{HANGUL[1]}]")), apart).otherwise(flat)


def fold_here(text: str) -> str:
    """fold for a query on the driver."""
    source, target = fold_tables()
    flat = text.translate(str.maketrans(source[: len(target)], target, source[len(target) :]))
    return "".join(unicodedata.normalize("NFD", c) if HANGUL[0] <= c <= HANGUL[1] else c for c in flat)


#: In the tables of characters: one that folds to nothing.
DROPPED = 0x110000


@cache
def _codes_to() -> np.ndarray:
    """What each character folds to, but for Hangul syllables."""
    source, target = fold_tables()
    to, at = np.arange(DROPPED, dtype=np.uint32), np.array([ord(c) for c in source])
    to[at] = DROPPED
    to[at[: len(target)]] = [ord(c) for c in target]
    return to


@cache
def space_codes() -> np.ndarray:
    """Whether each character is white space."""
    pattern = re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", SPACE), re.ASCII)
    found = np.zeros(DROPPED, bool)
    found[[ord(m[0]) for m in pattern.finditer("".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000))]] = True
    return found


def fold_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """fold for many texts in a task: the characters of all of them, a line end after each, and for each character the text that it is of."""
    apart = [re.sub(f"[{HANGUL[0]}-{HANGUL[1]}]", lambda m: unicodedata.normalize("NFD", m[0]), t) if not t.isascii() else t for t in texts]
    codes = _codes_to()[np.frombuffer("".join(t + "\n" for t in apart).encode("utf-32-le"), "<u4")]
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in apart])
    there = codes != DROPPED
    return (codes, of) if there.all() else (codes[there], of[there])


def terms_here(query: str) -> list[str]:
    return fold_here(query).split()


def terms(query: Column) -> Column:
    return F.filter(F.split(fold(query), SPACE + "+"), lambda x: x != "")


def has_terms(norm: Column, words: list[str]) -> Column:
    """Every word is a substring; no words match nothing."""
    if not words:
        return F.lit(False)
    found = F.contains(norm, F.lit(words[0]))
    for w in words[1:]:
        found = found & F.contains(norm, F.lit(w))
    return F.coalesce(found, F.lit(False))


#: Marks that folding drops.
MARK = r"[\p{M}&&[\x{0}-\x{FFFF}]]"


def place(text: Column, at: Column) -> Column:
    """Where the folded text's character `at` (from 0) stands in the text: folding drops combining marks and parts Hangul syllables.

    The text is taken apart behind marks and syllables, as far as `at` may reach. So a piece is letters of which the last alone may be a syllable, and then marks.
    """
    hangul = f"[{HANGUL[0]}-{HANGUL[1]}]"
    n = at.cast("int") + 2  # each piece has a letter, but for marks that the text may begin with
    pieces = F.slice(F.split(text, f"(?<={hangul}|{MARK})(?!{MARK})", n + 1), F.lit(1), n)

    def after(s: Column, piece: Column) -> Column:
        letters = F.regexp_replace(piece, f"{MARK}+", "")
        last = F.ascii(F.substr(letters, F.lit(-1), F.lit(1)))
        more = F.when(last.between(ord(HANGUL[0]), ord(HANGUL[1])), F.when((last - ord(HANGUL[0])) % FINALS == 0, 1).otherwise(2)).otherwise(0)
        here = s["left"] < F.length(letters) + more
        found = F.when(here, s["raw"] + F.least(s["left"], F.length(letters) - 1))
        return F.when(s["found"].isNotNull(), s).otherwise(F.struct((s["left"] - F.length(letters) - more).alias("left"), (s["raw"] + F.length(piece)).alias("raw"), found.alias("found")))

    zero = F.struct(at.cast("int").alias("left"), F.lit(0).alias("raw"), F.lit(None).cast("int").alias("found"))
    return F.when(F.rlike(text, F.lit(f"{hangul}|{MARK}")), F.aggregate(pieces, zero, after, lambda s: s["found"])).otherwise(at)


def hit(text: Column, words: list[str]) -> Column:
    """struct(start, end), from 0, of the first word's first place in the text itself; null unless all words are in it. The text is folded once, and the word looked for once."""
    first = words[0] if words else ""

    def placed(start: Column) -> Column:
        return F.struct(place(text, start).alias("start"), (place(text, start + len(first) - 1) + 1).alias("end"))

    def found(norm: Column) -> Column:
        return F.when(has_terms(norm, words), F.get(F.transform(F.array(F.instr(norm, first) - 1), placed), F.lit(0)))

    return F.get(F.transform(F.array(fold(text)), found), F.lit(0))


def with_hits(rows: DataFrame, text: str, words: list[str], name: str = "hit") -> DataFrame:
    """rows whose text column has all words, with their hit. A generator makes it, so filter and columns share one evaluation."""
    return rows.select("*", F.explode(F.array_compact(F.array(hit(F.col(text), words)))).alias(name))


def snippet(text: Column, start: Column, end: Column, around: int = 45, more: int = 15) -> Column:
    """struct(before, mark, after): about `around` characters on either side, on to the end of a word if near, on one line, with … where cut."""
    reach = F.lit(around + more)
    left = F.substr(text, F.greatest(start - reach, F.lit(0)) + 1, F.least(start, reach))
    before = F.regexp_extract(left, rf"(?s)\S{{0,{more}}}.{{0,{around}}}\z", 0)
    after = F.regexp_extract(F.substr(text, end + 1, reach), rf"(?s)^.{{0,{around}}}\S{{0,{more}}}", 0)
    one = lambda c: F.regexp_replace(c, r"\s+", " ")
    return F.struct(
        F.concat(F.when(F.length(before) < start, "…").otherwise(""), F.ltrim(one(before))).alias("before"),
        one(F.substr(text, start + 1, end - start)).alias("mark"),
        F.concat(F.rtrim(one(after)), F.when(end + F.length(after) < F.length(text), "…").otherwise("")).alias("after"),
    )


def file_name(name: Column, extension: str, default: str = "Escaneo") -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|]+', " "), SPACE + "+", " "))
    return F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit(default)), F.lit(f".{extension}"))


def human_size(size: Column) -> Column:
    kb, tenths = F.floor(size / 1024 + 0.5).cast("long"), F.floor(size / 104857.6 + 0.5).cast("long")
    mb = F.concat(F.floor(tenths / 10).cast("string"), F.lit(","), (tenths % 10).cast("string"), F.lit(" MB"))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1048576, F.concat(kb.cast("string"), F.lit(" KB"))).otherwise(mb)


def pages_label(n: Column) -> Column:
    return F.when(n == 1, "1 página").otherwise(F.concat(n.cast("string"), F.lit(" páginas")))


def join_hyphens(text: Column) -> Column:
    """A word that a line end cut is made whole."""
    return F.regexp_replace(text, "(\\p{L})[-‐]\n(?=\\p{Ll})", "$1")


#: What starts an entry of a list: a number, a letter or a bullet (fixed pattern).
LIST_ENTRY = r"(?iu)\n(?=(\(?\d{1,3}[.)°º-]|\(?[a-zñ][.)]|[•·▪◦\-–—])[^\S\n])"
#: White space but for the line end.
_BLANK = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}&&[^\n]]"


def blocks(text: Column) -> Column:
    """The parts of a text between blank lines."""
    return F.split(text, r"\n\s*\n")


def trimmed(text: Column) -> Column:
    """Without white space, as the library understands it, at either end. No pattern starts inside a run of white space, so long runs cost what they measure."""
    return F.regexp_replace(text, rf"\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def paragraphs(text: Column) -> Column:
    """Paragraphs of read text: blocks between blank lines with their lines joined; entries of lists stand alone."""

    def of(block: Column) -> Column:
        lines = F.regexp_replace(trimmed(block), rf"(?<!{SPACE}){_BLANK}*+\n{SPACE}*+", "\n")
        whole = F.transform(F.split(lines, LIST_ENTRY), lambda x: F.replace(join_hyphens(x), F.lit("\n"), F.lit(" ")))
        return F.filter(whole, lambda x: x != "")

    return F.flatten(F.transform(blocks(F.coalesce(text, F.lit(""))), of))


_CLOSE = re.compile(r"[.!?;:]+|\n+")


def _sentence_spans(text: str):
    """(start, end) of each stretch with the marks or line ends that close it; one of white space alone has none."""
    at = 0
    for stop, end in chain((m.span() for m in _CLOSE.finditer(text)), [(len(text), len(text))]):
        if stop > at and not text[at:end].isspace():
            yield at, end
        at = end


def _breaks(text: str, start: int, end: int, most: int) -> list[int]:
    """Places that cut text[start:end] into pieces of at most `most` characters: after the last space of a piece, if that is past its middle."""
    out = [start]
    while end - out[-1] > most:
        space = text.rfind(" ", out[-1], out[-1] + most) - out[-1]
        out.append(out[-1] + (space + 1 if 2 * space > most else most))
    return out[1:]


def sentences_here(text: str, most: int = 220, short: int = 60) -> list[tuple[int, int, str]]:
    """(start, end, text) of pieces to read aloud: sentences, cut if long, joined to the next if short.

    Pieces are kept as the places where they start and end; joining two drops the places between them.
    """
    starts, ends = [], []
    for a, b in _sentence_spans(text):
        cuts = _breaks(text, a, b, most)
        starts += [a, *cuts]
        ends += [*cuts, b]
        if len(ends) > 1 and ends[-2] - starts[-2] < short and b - starts[-2] <= most:
            del ends[-2], starts[-1]
    spoken = ((a, b, " ".join(text[a:b].replace("—", " ").replace("–", " ").split())) for a, b in zip(starts, ends, strict=True))
    return [x for x in spoken if x[2]]


def sentences():
    """A function from a text column to its sentences_here. The merging is sequential, so it is an Arrow function."""

    def of(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": a, "end": b, "text": x} for a, b, x in sentences_here(t or "")])

    return F.pandas_udf(of, "array<struct<start:int,end:int,text:string>>")


def with_page_headers(pages: Column) -> Column:
    """An array of struct(n, text), in order, as one text with a header line for each page."""
    return F.array_join(F.transform(pages, lambda p: F.concat(F.lit("— Página "), p["n"].cast("string"), F.lit(" —\n"), p["text"])), "\n\n")


def split_by_headers(text: Column) -> Column:
    """The inverse of with_page_headers: struct(n, text) for each header line."""
    header = r"(?m)^— Página (\d+) —$\n?"
    numbers = F.regexp_extract_all(text, F.lit(header), F.lit(1))
    parts = F.split(text, header)
    bodies = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.regexp_replace(x, r"\n*\z", ""))
    return F.zip_with(numbers, bodies, lambda n, t: F.struct(n.cast("int").alias("n"), t.alias("text")))


def translation_segments(text: Column) -> Column:
    """struct(text, translate): headers and blank separators are not to translate; the lines between them are, together."""
    marked = F.regexp_replace(text, r"(\n[ \t]*\n+)", "\u0001$1\u0001")
    parts = F.filter(F.split(marked, "\u0001"), lambda x: x != "")

    def lines(part: Column) -> Column:
        cut = F.split(F.regexp_replace(part, r"(?m)^([ \t]*— Página \d+ —[ \t]*)$", "\u0002$1\u0002"), "\u0002")
        cut = F.transform(cut, lambda x: F.regexp_replace(x, r"^\n|\n$", ""))
        cut = F.filter(cut, lambda x: x != "")
        return F.transform(cut, lambda x: F.struct(x.alias("text"), (~F.rlike(F.trim(x), F.lit(r"^— Página \d+ —$")) & (F.trim(x) != "")).alias("translate")))

    return F.flatten(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\s*$")), F.array(F.struct(p.alias("text"), F.lit(False).alias("translate")))).otherwise(lines(p))))


def xml_escape(text: Column) -> Column:
    clean = F.regexp_replace(text, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        clean = F.replace(clean, F.lit(a), F.lit(b))
    return clean


def pdf_title(text: Column) -> Column:
    """A PDF hexadecimal string, UTF-16 with its mark."""
    return F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">"))


def without_bullet(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*[•·▪◦\-–—]\s*", "")


def topic(name: Column, folder: Column) -> Column:
    """A document's topic from its name, unless the name was given automatically."""
    auto = F.rlike(name, F.lit(r"^Escaneo\b")) | (folder.isNotNull() & (folder != "") & F.startswith(name, folder))
    return F.when(auto, "").otherwise(name)


def next_place(text: Column, word: Column, cursor: Column) -> Column:
    """Where a spoken word stands from the cursor on, from 0; -1 if it does not."""
    return F.position(word, text, cursor + 1) - 1


def is_pdf(mime: Column, name: Column) -> Column:
    return F.coalesce(mime == "application/pdf", F.lit(False)) | F.rlike(F.coalesce(name, F.lit("")), F.lit(r"(?i)\.pdf$"))


def pdf_document_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "_+", " "))


def version_key(version: str, filter_: Column, rotation: Column, flat: Column, fingers: Column, width: Column, height: Column, corners: Column, brightness: Column, contrast: Column) -> Column:
    """What a page's read text depends on; the text is stale once this differs. Missing flags count as true, missing light as 0."""
    size = F.concat_ws("x", width.cast("string"), height.cast("string"))
    flag = lambda c: F.coalesce(c, F.lit(True)).cast("string")
    light = F.when((F.coalesce(brightness, F.lit(0)) != 0) | (F.coalesce(contrast, F.lit(0)) != 0), F.concat(F.lit("luz"), F.coalesce(brightness, F.lit(0)).cast("string"), F.lit(","), F.coalesce(contrast, F.lit(0)).cast("string")))
    return F.concat_ws("|", F.lit(version), filter_, F.coalesce(rotation, F.lit(0)).cast("string"), flag(flat), flag(fingers), size, corners, light)


def wrap_note(text: str, room: float, width: Callable[[str], float]) -> list[str]:
    """The lines of a note in `room` units, by the font's width of a text: line ends stay, words that don't fit alone are cut where they must be."""

    def pieces(word: str):
        while len(word) > 1 and width(word) > room:
            fit = max(1, bisect_right(range(1, len(word)), room, key=lambda n: width(word[:n])))
            yield word[:fit], True
            word = word[fit:]
        yield word, False

    lines: list[str] = []
    for paragraph in text.split("\n"):
        now: list[str] = []
        for piece, full in (p for word in paragraph.split() for p in pieces(word)):
            if now and (full or width(" ".join([*now, piece])) > room):
                lines.append(" ".join(now))
                now = []
            if full:
                lines.append(piece)
            else:
                now.append(piece)
        lines.append(" ".join(now))
    return lines


def wrapped(room: float, widths: dict[str, float], other: float):
    """A function from a text column to the lines of notes, by the widths of a font's characters; `other` is the width of those not named."""

    def of(notes: pd.Series) -> pd.Series:
        return notes.map(lambda t: None if t is None else wrap_note(t, room, lambda s: sum(widths.get(c, other) for c in s)))

    return F.pandas_udf(of, "array<string>")
