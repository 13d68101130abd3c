"""Positioned text of PDF files: unencrypted ones, whose fonts are simple or say what their codes mean.

A file is read where its row is, a page a row: pieces with their place from the page's top, which operators.layout puts into lines.
Object streams are read; fonts without a table of meanings count as Windows-1252, characters without a width as 0.556 em (0.6 for
Courier). A file that isn't a PDF, or is encrypted, has no pages.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

PIECES = "path string, page int, str string, x double, y double, h double, w double"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(
    rb"\((?:[^()\\]|\\[\s\S]|\((?:[^()\\]|\\[\s\S])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|[\[\]]|/[^\s<>\[\]()/%]*|[-+]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9*]*|%[^\r\n]*"
)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|[\s\S])")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


def objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """Each object's dictionary, as bytes, and its stream, inflated."""
    out: dict[int, tuple[bytes, bytes]] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        end = data.find(b"endobj", m.end())
        start = re.compile(rb">>\s*stream\r?\n").search(data, m.end(), end if end > 0 else len(data))
        if start:
            head = data[m.end() : start.start() + 2]
            length = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
            stop = start.end() + int(length[1]) if length else data.find(b"endstream", start.end())
            body = data[start.end() : stop]
            if b"FlateDecode" in head:
                try:
                    body = zlib.decompressobj().decompress(body)
                except zlib.error:
                    body = b""
            end = data.find(b"endobj", stop)
        else:
            head, body = data[m.end() : end if end > 0 else len(data)], b""
        out[int(m[1])] = (head, body)
        at = end + 6 if end > 0 else len(data)
    for head, body in list(out.values()):
        if b"/ObjStm" in head and (first := re.search(rb"/First\s+(\d+)", head)):
            numbers = [int(x) for x in body[: int(first[1])].split()]
            starts = [int(first[1]) + x for x in numbers[1::2]]
            for name, a, b in zip(numbers[::2], starts, [*starts[1:], len(body)], strict=False):
                out.setdefault(name, (body[a:b], b""))
    return out


class Pages:
    """The pages of a file in order, with what they inherit."""

    def __init__(self, data: bytes):
        self.objects = objects(data) if data[:5] == b"%PDF-" and b"/Encrypt" not in data else {}

    def value(self, head: bytes, key: bytes) -> bytes:
        """What stands after a key: an object's dictionary for a reference, else the text from there to its end."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z0-9])\s*", head)
        if not m:
            return b""
        ref = _REF.match(head, m.end())
        return self.objects.get(int(ref[1]), (b"", b""))[0] if ref else _balanced(head[m.end() :])

    def __iter__(self) -> Iterator[tuple[float, bytes, bytes]]:
        """(height, resources, content)"""
        root = next((h for h, _ in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", h)), b"")
        stack, seen = [(self.value(root, b"Pages"), b"", b"")], set()
        while stack:
            node, box, resources = stack.pop()
            box, resources = self.value(node, b"MediaBox") or box, self.value(node, b"Resources") or resources
            if re.search(rb"/Type\s*/Pages\b", node):
                kids = [int(k) for k in _REF.findall(self.value(node, b"Kids"))]
                stack += [(self.objects.get(k, (b"", b""))[0], box, resources) for k in reversed(kids) if not (k in seen or seen.add(k))]
            elif re.search(rb"/Type\s*/Page\b", node):
                m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", node)
                parts = [self.objects.get(int(k), (b"", b""))[1] for k in _REF.findall(m[1])] if m else []
                corners = [float(x) for x in re.findall(rb"[-+.\d]+", box)] or [0, 0, 612, 792]
                yield corners[3], resources, b"\n".join(parts)


def _balanced(text: bytes) -> bytes:
    """A dictionary, an array or a single value from the start of a text."""
    depth = 0
    for m in _TOKEN.finditer(text):
        depth += (m[0] in (b"<<", b"[")) - (m[0] in (b">>", b"]"))
        if depth <= 0:
            return text[: m.end()]
    return text


class Font:
    """What a font's codes mean and how wide they are, in em."""

    def __init__(self, pages: Pages, head: bytes):
        self.size = 2 if b"/Type0" in head else 1
        self.default = 0.6 if b"Courier" in head else 0.556
        first, widths = re.search(rb"/FirstChar\s+(\d+)", head), re.findall(rb"[-+.\d]+", pages.value(head, b"Widths"))
        self.widths = {int(first[1]) + k: float(x) / 1000 for k, x in enumerate(widths)} if first else {}
        self.meanings: dict[int, str] = {}
        if ref := re.search(rb"/ToUnicode\s+(\d+)", head):
            table = pages.objects.get(int(ref[1]), (b"", b""))[1]
            said = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for block in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
                self.meanings |= {int(a, 16): said(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
            for block in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                    self.meanings |= {k: chr(min(int(c, 16) + k - int(a, 16), 0x10FFFF)) for k in range(int(a, 16), min(int(b, 16), int(a, 16) + 65_535) + 1)}

    def read(self, raw: bytes) -> list[tuple[str, float]]:
        codes = [int.from_bytes(raw[k : k + self.size], "big") for k in range(0, len(raw), self.size)]
        plain = lambda c: bytes([c]).decode("cp1252", "replace") if c < 256 else "\ufffd"
        return [(self.meanings.get(c) or plain(c), self.widths.get(c, self.default)) for c in codes]


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else _PLAIN.get(m[1], m[1]), token[1:-1])


def pieces(height: float, content: bytes, fonts: dict[bytes, Font]) -> list[tuple[str, float, float, float, float]]:
    """(str, x, y from the top, h, w) of each string that a page's content shows."""
    matrix = lambda *v: np.array([[v[0], v[1], 0], [v[2], v[3], 0], [v[4], v[5], 1]], float)
    out, stack, saved = [], [], []
    base, line, place = np.eye(3), np.eye(3), np.eye(3)
    s = {"font": None, "size": 1.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0}

    def show(token: bytes):
        nonlocal place
        read = (s["font"] or fonts.setdefault(b"", Font(Pages(b""), b""))).read(_bytes(token))
        wide = sum((w * s["size"] + s["Tc"] + (s["Tw"] if t == " " else 0)) * s["Tz"] / 100 for t, w in read)
        m = place @ base
        out.append(("".join(t for t, _ in read), m[2, 0], height - m[2, 1], s["size"] * float(np.hypot(m[1, 0], m[1, 1])), wide * float(np.hypot(m[0, 0], m[0, 1]))))
        place = matrix(1, 0, 0, 1, wide, 0) @ place

    def move(x: float, y: float):
        nonlocal line, place
        line = place = matrix(1, 0, 0, 1, x, y) @ line

    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/+-.0123456789" and t not in (b"<<", b">>"):
            stack.append(t)
            continue
        numbers = [float(x) for x in stack if x[:1] in b"+-.0123456789"]
        strings = [x for x in stack if x[:1] in b"(<"]
        if t == b"q":
            saved.append((base, dict(s)))
        elif t == b"Q" and saved:
            base, s = saved.pop()
        elif t == b"cm" and len(numbers) >= 6:
            base = matrix(*numbers[-6:]) @ base
        elif t == b"BT":
            line = place = np.eye(3)
        elif t == b"Tf" and numbers:
            s["font"], s["size"] = fonts.get(next((x[1:] for x in stack if x[:1] == b"/"), b"")), numbers[-1]
        elif t in (b"Tc", b"Tw", b"Tz", b"TL") and numbers:
            s[t.decode()] = numbers[-1]
        elif t in (b"Td", b"TD") and len(numbers) >= 2:
            s["TL"] = -numbers[-1] if t == b"TD" else s["TL"]
            move(*numbers[-2:])
        elif t == b"Tm" and len(numbers) >= 6:
            line = place = matrix(*numbers[-6:])
        elif t == b"T*":
            move(0, -s["TL"])
        elif t in (b"Tj", b"'", b'"') and strings:
            if t != b"Tj":
                move(0, -s["TL"])
            show(strings[-1])
        elif t == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    show(x)
                elif x[:1] in b"+-.0123456789":
                    place = matrix(1, 0, 0, 1, -float(x) / 1000 * s["size"] * s["Tz"] / 100, 0) @ place
        stack = []
    return out


def text_pieces(files: DataFrame) -> DataFrame:
    """files (path, content): the pieces of every page, which is numbered from 1. Strings without a letter or width are left out by layout."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PIECES.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                pages = Pages(bytes(content))
                for n, (height, resources, shown) in enumerate(pages, 1):
                    fonts = {name: Font(pages, pages.objects.get(int(ref), (b"", b""))[0]) for name, ref in re.findall(rb"/(\S+?)\s+(\d+)\s+\d+\s+R", pages.value(resources, b"Font"))}
                    yield pd.DataFrame([(path, n, *p) for p in pieces(height, shown, fonts)], columns=names)

    return files.select("path", "content").mapInPandas(read, PIECES)
