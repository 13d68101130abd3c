"""Whole texts to token ids with a tokenizer file of the `tokenizers` library, through a bounded cache of segments.

A text is cut only where the tokenizer's own pre-tokenizer cuts in any case: before a space that has a character other
than white space on at least one side. Each segment is encoded by the library, once while it is in the cache, so the ids
are those of encoding the whole text. A segment of Latin letters only is one pre-token, and goes straight to the
library's BPE model. Files with another pre-tokenizer or normalizer than these two kinds are encoded whole. (array's codes H and I are the machine's byte order; the files are little-endian, as are all
machines that the library supports.)
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from ._common import WORKER_CACHES, fresh_worker

#: A space after white space is no sure cut.
_AFTER_SPACE = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
_AFTER_ASCII_SPACE = [x for x in _AFTER_SPACE if x.isascii()]
#: What Python takes for white space and the tokenizers don't.
_SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")
_CUT = re.compile(r" (?=\S)(?<=\S )")
#: Letters up to U+024F, of which all are letters to every version of Unicode.
_LETTERS = re.compile("([A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)")


#: The split of lower-case vocabularies without white space, as their file has it.
WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def known_cuts(file: dict, keep_space: bool) -> bool:
    """Whether a tokenizer's file says that texts may be cut as this module cuts them; others are encoded whole."""
    cutter, norm = file.get("pre_tokenizer") or {}, file.get("normalizer") or {}
    if file.get("truncation") or file.get("padding") or file["model"].get("type") != "BPE" or any(t["lstrip"] or t["rstrip"] or t["content"] != t["content"].strip() for t in file.get("added_tokens", [])):
        return False
    if keep_space:
        return not norm and cutter.get("type") == "ByteLevel" and cutter.get("use_regex") is True and not cutter.get("add_prefix_space")
    steps, parts = norm.get("normalizers") or [], cutter.get("pretokenizers") or []
    return (
        [x.get("type") for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"] and parts[0].get("pattern") == {"Regex": WORDS_ONLY} and parts[1].get("use_regex") is False
    )


class SegmentEncoder:
    """keep_space: whether a segment keeps the space before it (byte-level vocabularies) or a space makes no token."""

    def __init__(self, path: str, keep_space: bool, max_entries: int = 800_000, max_chars: int = 14_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = known_cuts(json.loads(self.tokenizer.to_str()), keep_space)
        self.keep_space, self.space = keep_space, " " if keep_space else ""
        self.dtype, self.code = ("<u2", "H") if self.tokenizer.get_vocab_size() <= 1 << 16 else ("<u4", "I")
        self.max_entries, self.max_chars = max_entries, max_chars
        self.symbols = _byte_symbols()
        self.head = self.space.translate(self.symbols)
        self.cache: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}  # of segments without a space before them
        self.chars = 0
        self.marks = {m: self._whole(m) for m in ".,"}
        self.line_end = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _letters(self, s: str, space: bool = True) -> bytes | None:
        """Ids of a segment of Latin letters, which is one pre-token; None where lower-casing makes it more than that."""
        if not self.keep_space and not (s := s.lower()).isalpha():
            return None
        symbols = (self.head if space else "") + (s if s.isascii() else s.encode().decode("latin-1").translate(self.symbols))
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(symbols)]).tobytes()

    def _learn(self, segments: set[str]) -> None:
        rest, cache = [], self.cache
        for s in segments:
            ids = self._lines(s) if "\n" in s else self._word(s, cache, True)
            if ids:
                cache[s] = ids
            else:
                rest.append(s)
        for s, e in zip(rest, self.tokenizer.encode_batch_fast([self.space + s for s in rest], add_special_tokens=False), strict=True):
            cache[s] = array(self.code, e.ids).tobytes()
        self.chars += sum(map(len, segments))

    def _word(self, s: str, cache: dict[str, bytes], space: bool) -> bytes | None:
        """Ids of Latin letters and perhaps a mark; None for any other segment."""
        stem, mark = (s[:-1], s[-1]) if s[-1:] in self.marks else (s, "")
        if not (stem.isalpha() and (stem.isascii() or _LETTERS.fullmatch(stem))) or not (self.keep_space or stem.isascii() or stem.lower().isalpha()):
            return None  # what lower-casing makes more than letters is the library's, with its mark
        ids = cache.get(stem) or self._letters(stem, space)
        if ids and mark:
            cache[stem] = ids
            ids += self.marks[mark]
        return ids

    def _lines(self, s: str) -> bytes | None:
        """Ids of a segment that goes over line ends, each between two characters that aren't white space: these are pre-tokens of their own."""
        parts = s.split("\n")
        if not self.keep_space or parts != s.split():
            return None
        out = [self.cache.get(parts[0]) or self._word(parts[0], self.cache, True)]
        for p in parts[1:]:
            ids = self.bare.get(p) or self._word(p, self.bare, False) or self._whole(p)
            self.bare[p] = ids
            out += [self.line_end, ids]
        return b"".join(out) if out[0] else None

    def _cut(self, text: str) -> list[str]:
        if not self.keep_space:  # no token of these vocabularies holds white space, and all are lower-case
            if any(x in text for x in _SEPARATORS):
                return _CUT.split(text)
            try:
                text.encode("latin-1")
                text = text.lower()
            except UnicodeEncodeError:
                pass
            return text.split() or [""]
        if text[:1] == " " or any(x in text for x in (_AFTER_ASCII_SPACE if text.isascii() else _AFTER_SPACE)):
            return _CUT.split(text)
        return text.split(" ")

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cuts:
            return [np.frombuffer(self._whole(t), self.dtype) for t in texts]
        if len(self.cache) > self.max_entries or self.chars > self.max_chars:
            self.cache, self.bare, self.chars = {}, {}, 0
        cut, found, gaps = [self._cut(t) for t in texts], [], []
        get, new = self.cache.get, set()
        for segments in cut:
            ids = list(map(get, segments))
            # all() is much cheaper than looking for None, and most texts have few segments that are new.
            missing = [] if all(ids) else [k for k, x in enumerate(ids) if x is None]
            new.update([segments[k] for k in missing])
            found.append(ids)
            gaps.append(missing)
        if new:
            self._learn(new)
        cache, out = self.cache, []
        for segments, ids, missing in zip(cut, found, gaps, strict=True):
            for k in missing:
                ids[k] = cache[segments[k]]
            if self.keep_space or not segments[0]:  # the first has no space before it
                ids[0] = self._whole(segments[0]) if segments[0] else b""
            out.append(np.frombuffer(b"".join(ids), self.dtype))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


_encoders: dict[tuple[str, bool], SegmentEncoder] = {}
WORKER_CACHES.append(_encoders)


def shared_encoder(path: str, keep_space: bool) -> SegmentEncoder:
    """This process's encoder: a worker's later tasks go on with its cache."""
    if (path, keep_space) not in _encoders:
        fresh_worker()  # what stages before this one left would stand beside the encoder's cache
        _encoders[path, keep_space] = SegmentEncoder(path, keep_space)
    return _encoders[path, keep_space]
