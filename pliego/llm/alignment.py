"""Token ids of two tokenizers aligned by the bytes at which both have an end, and how often each pair of ids is linked.

A text is cut before each space between two characters that aren't white space; both tokenizers cut there in any case (a test holds both to whole texts), so a part is tokenized and
aligned once while it is in a worker's cache. A link is a pair of tokens that end at the same byte; the tokens between two such bytes are a group.

1. Documents are read in chunks. A chunk is written as one row of its documents' figures and, for each stripe of B's ids (id mod stripes), one row of
   its links: the distinct pairs of ids with their counts, and under each pair the chunk's documents that have it, as deltas.
2. Pairs are added up in each task, then dealt by stripe; a task adds what comes into the dense matrix of the stripe, ids of B by ids of A, with
   np.add.at. Row maxima are the best counts. The cells in use are written: as many as distinct pairs, whatever the number of texts.
3. Links are dealt by stripe again, in groups of `group_chunks` chunks, each with the stripe's cells (cogrouped), and give each document's sums; these are added up by
   chunk. So no task holds all counts, a hot id is in one stripe but in as many groups as there are chunks, and nothing but rows of tables is moved.

Defined results: a null or empty text, or one of which either tokenizer's bytes aren't a space and the text, has no tokens (zeros, groups null); null and
repeated ids and repeated rows are each answered, each row counting in the corpus; an empty table gives no rows; other columns are ignored. A document is whole in one task and one chunk.
"""

from __future__ import annotations

import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WORKER_CACHES, fresh_worker, materialize, prepare, shuffle_partitions, task_number
from .encoding import _CUT, _byte_symbols

CHUNK_ROWS = "chunk_id long, stripe int, pairs binary, links binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
#: Documents of a chunk at most; their numbers are the low bits of what is sorted.
MOST_DOCS = 1 << 16


class SegmentAligner:
    """Aligns texts by two tokenizer files: a byte-level BPE of the tokenizers library (A), and a sentencepiece model (B)."""

    def __init__(self, path_a: str, path_b: str, max_entries: int = 350_000, max_chars: int = 8_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in texts are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in _byte_symbols().items()}
        size_a = self.a.get_vocab_size()
        tokens = [self.a.id_to_token(i) or "" for i in range(size_a)]
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece of B goes over a space, so texts can't be cut there")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = len(self.bytes_a), len(self.bytes_b)
        self.size_a, self.size_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.said_a, self.said_b = list(map(str, range(self.sizes[0]))), list(map(str, range(self.sizes[1])))
        self.max_entries, self.max_chars = max_entries, max_chars
        self.cache: dict[str, tuple | bool] = {}
        self.chars = 0

    def _aligned(self, segment: str, a: list[int], b: list[int]) -> tuple | bool:
        """(tokens of A, tokens of B, links, the links' codes, the groups as text); False where bytes differ."""
        whole = b" " + segment.encode("utf-8", "surrogatepass")
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return False
        said_a, said_b, size_a, size_b, width = self.said_a, self.said_b, self.size_a, self.size_b, self.sizes[0]
        codes, groups, j, at_a, at_b, first_a, first_b = array("q"), [], 0, 0, 0, 0, 0
        for i, x in enumerate(a, 1):
            at_a += size_a[x]
            while at_b < at_a:
                y = b[j]
                at_b += size_b[y]
                j += 1
            if at_a == at_b:
                codes.append(y * width + x)
                if i - first_a == 1 == j - first_b:
                    groups.append(f"{said_a[x]}|{said_b[y]}")
                else:
                    groups.append(f"{','.join([said_a[k] for k in a[first_a:i]])}|{','.join([said_b[k] for k in b[first_b:j]])}")
                first_a, first_b = i, j
        return len(a), len(b), len(codes), codes.tobytes(), ";".join(groups)

    def _learn(self, segments: list[str]) -> dict:
        found = self.a.encode_batch_fast([" " + s for s in segments], add_special_tokens=False)
        return {s: self._aligned(s, x.ids, y) for s, x, y in zip(segments, found, self.b.encode(segments, num_threads=1), strict=True)}

    def align(self, texts: list[str]) -> list[tuple | bool]:
        """For each text what _aligned gives for the whole of it."""
        if len(self.cache) > self.max_entries or self.chars > self.max_chars:
            self.cache, self.chars = {}, 0
        cut = [_CUT.split(t) if t else [] for t in texts]
        new = {s for parts in cut for s in parts}.difference(self.cache)
        long = {s for s in new if len(s) > 200}
        short = list(new - long)
        self.chars += sum(map(len, short))
        for k in range(0, len(short), 20_000):
            self.cache |= self._learn(short[k : k + 20_000])
        out = []
        for parts in cut:
            got = [self.cache[s] if s not in long else self._learn([s])[s] for s in parts] if long else [self.cache[s] for s in parts]
            if not parts or not all(got):
                out.append(False)
                continue
            n_a, n_b, n, codes, groups = zip(*got, strict=True)
            out.append((sum(n_a), sum(n_b), sum(n), b"".join(codes), ";".join(groups)))
        return out


_aligners: dict[tuple[str, str], SegmentAligner] = {}
WORKER_CACHES.append(_aligners)


def shared_aligner(path_a: str, path_b: str) -> SegmentAligner:
    if (path_a, path_b) not in _aligners:
        fresh_worker()
        _aligners[path_a, path_b] = SegmentAligner(path_a, path_b)
    return _aligners[path_a, path_b]


def squeezed(numbers: np.ndarray) -> bytes:
    """Non-negative whole numbers, compressed: as few bytes each as the largest needs, one plane for each byte."""
    import zstandard

    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(numbers.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return np.array([len(numbers), width], "<i8").tobytes() + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    import zstandard

    n, width = np.frombuffer(raw, "<i8", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[16:], max_output_size=n * width), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(-1)


def joined(*arrays: np.ndarray) -> bytes:
    parts = [squeezed(x) for x in arrays]
    return np.array([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)


def parted(raw: bytes, k: int) -> list[np.ndarray]:
    at, out = 8 * k, []
    for n in np.frombuffer(raw, "<i8", k).tolist():
        out.append(unsqueezed(raw[at : at + n]))
        at += n
    return out


def _rows(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_CHUNK_ROWS = [("chunk_id", pa.int64()), ("stripe", pa.int32()), ("pairs", pa.binary()), ("links", pa.binary())]
_FIGURES = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]


def chunk_links(doc_codes: list[bytes], width: int, stripes: int):
    """(stripe, pairs, links) of a chunk: the codes of each document's links, with how often, under each distinct code."""
    codes = np.frombuffer(b"".join(doc_codes), np.int64)
    doc_of = np.repeat(np.arange(len(doc_codes)), [len(c) // 8 for c in doc_codes])
    keys, times = np.unique(codes << 16 | doc_of, return_counts=True)
    stripe = ((keys >> 16) // width % stripes).astype(np.uint16)
    order = np.argsort(stripe, kind="stable")  # codes stay in order
    keys, times = keys[order], times[order]
    edges = np.searchsorted(stripe[order], np.arange(stripes + 1))
    for s in range(stripes):
        k, t = keys[edges[s] : edges[s + 1]], times[edges[s] : edges[s + 1]]
        if not len(k):
            continue
        code, docs = k >> 16, k & 0xFFFF
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        step = np.diff(docs, prepend=0)
        step[first] = docs[first]  # documents ascend under a code
        yield s, joined(np.diff(code[first], prepend=0), np.add.reduceat(t, first)), joined(np.diff(np.append(first, len(k))), step, t)


def aligned_chunks(docs: DataFrame, path_a: str, path_b: str, stripes: int, chunk_bytes: int) -> DataFrame:
    """CHUNK_ROWS: for each chunk a row of stripe -1 with its documents' figures (an Arrow stream in `pairs`), and its links by stripe."""

    def work(batches):
        aligner = shared_aligner(path_a, path_b)
        base, made, size, figures, codes = task_number() << 32, 0, 0, [], []

        def out():
            sink = pa.BufferOutputStream()
            table = _rows(figures, _FIGURES)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(table)
            yield _rows([(base + made, -1, sink.getvalue().to_pybytes(), None)], _CHUNK_ROWS)
            if any(codes):
                yield _rows([(base + made, *x) for x in chunk_links(codes, aligner.sizes[0], stripes)], _CHUNK_ROWS)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for k in range(0, len(ids), 50):
                part = [t or "" for t in texts[k : k + 50]]
                for i, t, found in zip(ids[k : k + 50], part, aligner.align(part), strict=True):
                    n_a, n_b, n, links, groups = found or (0, 0, 0, b"", None)
                    figures.append((i, n_a, n_b, n, None if groups is None else hashlib.sha256(groups.encode()).hexdigest()))
                    codes.append(links)
                    size += len(t)
                    if size >= chunk_bytes or len(codes) == MOST_DOCS:
                        yield from out()
                        made, size, figures, codes = made + 1, 0, [], []
        if figures:
            yield from out()

    chosen = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return chosen.mapInArrow(work, CHUNK_ROWS)


CELLS = "stripe int, cells binary"
_CELLS = [("stripe", pa.int32()), ("cells", pa.binary())]


def pair_sums(chunks: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(stripe, cells): codes and counts, added up over what a task reads, up to `most` at a time."""

    def work(batches):
        held: dict[int, list] = {}
        n = 0

        def out():
            for s, parts in held.items():
                codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                counts = np.zeros(len(codes), np.int64)
                np.add.at(counts, at.reshape(-1), np.concatenate([t for _, t in parts]))
                yield _rows([(s, joined(np.diff(codes, prepend=0), counts))], _CELLS)

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step, counts = parted(raw, 2)
                held.setdefault(s, []).append((np.cumsum(step), counts))
                n += len(step)
            if n > most:
                yield from out()
                held, n = {}, 0
        yield from out()

    return chunks.where("stripe >= 0").select("stripe", "pairs").mapInArrow(work, CELLS)


def stripe_counts(sums: DataFrame, sizes: tuple[int, int], stripes: int) -> DataFrame:
    """(stripe, cells): codes in use, their counts over all texts and whether a count is the highest of its id of B; one row per stripe.

    A stripe's rows come to one task, one after the other, into its dense matrix.
    """
    width, height = sizes

    def work(batches):
        block, at = None, None

        def out():
            cells = np.flatnonzero(block)
            counts = block.reshape(-1)[cells]
            best = block.max(axis=1)
            row, a = np.divmod(cells, width)
            codes = (row * stripes + at) * width + a
            yield _rows([(at, joined(np.diff(codes, prepend=0), counts, (counts == best[row]).astype(np.int64)))], _CELLS)

        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != at:
                    if block is not None:
                        yield from out()
                    block, at = None, s
                    block = np.zeros((-(-height // stripes), width), np.int64)
                step, counts = parted(raw, 2)
                b, a = np.divmod(np.cumsum(step), width)
                np.add.at(block, (b // stripes, a), counts)
        if block is not None:
            yield from out()

    n = min(stripes, max(shuffle_partitions(sums.sparkSession), stripes // 4))
    return sums.repartition(n, "stripe").sortWithinPartitions("stripe").mapInArrow(work, CELLS)


def chunk_scores(chunks: DataFrame, counts: DataFrame, n_chunks: int, group_chunks: int) -> DataFrame:
    """CHUNK_ROWS of each chunk's and stripe's documents with links: `links` has their numbers, how many links are the best of their id of B, and the sum of counts."""
    groups = max(1, -(-n_chunks // group_chunks))
    left = chunks.where("stripe >= 0").withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.lit(groups)))
    right = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def score(links: pa.Table, cells: pa.Table) -> pa.Table:
        out = []
        if links.num_rows:
            step, counts, best = parted(cells.column("cells")[0].as_py(), 3)
            known = np.cumsum(step)
            for chunk, s, pairs, raw in zip(*[links.column(c).to_pylist() for c in ("chunk_id", "stripe", "pairs", "links")], strict=True):
                at = np.searchsorted(known, np.cumsum(parted(pairs, 2)[0]))
                n, step, times = parted(raw, 3)
                docs = np.cumsum(step)
                first = np.cumsum(n) - n
                docs -= np.repeat(np.where(first > 0, docs[first - 1], 0), n)
                which = np.repeat(at, n)
                there, of = np.unique(docs, return_inverse=True)
                good, total = np.zeros(len(there), np.int64), np.zeros(len(there), np.int64)
                np.add.at(good, of, times * best[which])
                np.add.at(total, of, times * counts[which])
                out.append((chunk, s, None, joined(np.diff(there, prepend=0), good, total)))
        return pa.Table.from_batches([_rows(out, _CHUNK_ROWS)])

    return left.groupBy("stripe", "part").cogroup(right.groupBy("stripe", "part")).applyInArrow(score, CHUNK_ROWS)


def align(docs: DataFrame, path_a: str, path_b: str, stripes: int = 64, chunk_bytes: int = 4 << 20, group_chunks: int = 256) -> DataFrame:
    """One row per document: ALIGNED with n_best and count_sum."""
    spark = docs.sparkSession
    prepare(spark)
    sizes = vocabulary_sizes(path_a, path_b)
    chunks, _ = materialize(aligned_chunks(docs, path_a, path_b, stripes, chunk_bytes), "aligned")
    counts, _ = materialize(stripe_counts(pair_sums(chunks), sizes, stripes), "pair-counts")
    figures = chunks.where("stripe < 0")
    scores = chunk_scores(chunks, counts, figures.count(), group_chunks)

    def finish(table: pa.Table) -> pa.Table:
        kind, rows = table.column("stripe").to_pylist(), table.column("links").to_pylist()
        own = kind.index(-1)
        docs = pa.ipc.open_stream(table.column("pairs")[own].as_py()).read_all()
        best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
        for k, raw in enumerate(rows):
            if k != own:
                step, good, sums = parted(raw, 3)
                there = np.cumsum(step)
                best[there] += good
                total[there] += sums
        links = docs.column("n_links")
        columns = [docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), links, links, docs.column("groups_sha256"), pa.array(best), pa.array(total)]
        return pa.table(columns, names=[x.split()[0] for x in ALIGNED.split(", ")] + ["n_best", "count_sum"])

    together = figures.unionByName(scores).groupBy("chunk_id")
    return together.applyInArrow(finish, ALIGNED + ", n_best long, count_sum long")


def vocabulary_sizes(path_a: str, path_b: str) -> tuple[int, int]:
    import sentencepiece
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path_a).get_vocab_size(), sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
