"""Sources: files, archives, backups, JPEG headers."""

from __future__ import annotations

import io
import struct
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "path string, name string, content binary"
MOST_BYTES = 300 << 20

#: What a backup keeps of a page, with its type and what stands for it where it is missing. Read text, marks and covers are kept as they are, whatever they hold.
PAGE_FIELDS: dict[str, tuple[str, object]] = {
    "ancho": ("int", None), "alto": ("int", None), "esquinas": ("array<struct<x:double,y:double>>", None), "filtro": ("string", None), "rotacion": ("int", 0),
    "procAncho": ("int", None), "procAlto": ("int", None), "creada": ("bigint", None), "ocr": ("variant", None), "nitidez": ("double", None),
    "aplanar": ("boolean", True), "aplanada": ("boolean", False), "dedos": ("boolean", True), "sinDedos": ("boolean", False), "brillo": ("int", 0), "contraste": ("int", 0),
    "marcas": ("variant", None), "modo": ("string", None), "portada": ("variant", None),
}
_PAGE = ",".join(["id:string", *(f"{n}:{t}" for n, (t, _) in PAGE_FIELDS.items()), "original:string", "procesada:string"])
_DOCUMENT = f"struct<id:string,nombre:string,creado:bigint,modificado:bigint,carpetaId:string,paginas:array<struct<{_PAGE}>>>"

#: The manifest of a backup; keys that it doesn't name are never read.
MANIFEST = f"app string, version int, carpetas array<struct<id:string,nombre:string,creada:bigint>>, documentos array<{_DOCUMENT}>"


def files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths))


def images(spark: SparkSession, *paths: str) -> DataFrame:
    """Decoded images as struct(origin, height, width, nChannels, mode, data); data is BGR from Spark's decoder."""
    return spark.read.format("image").load(list(paths))


def exif_orientation(data: bytes) -> int:
    """The orientation (1 to 8) that a JPEG's EXIF block tells; 1 without one."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xDA, 0xD9):
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        block = data[at + 4 : at + 2 + size]
        if kind == 0xE1 and block[:6] == b"Exif\0\0":
            tiff, order = block[6:], {b"II": "little", b"MM": "big"}.get(block[6:8])
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: E731, B023
            if order and number(2, 2) == 42:
                first = number(4, 4)
                for e in range(first + 2, first + 2 + 12 * number(first, 2), 12):
                    if number(e, 2) == 0x0112 and number(e + 2, 2) == 3:
                        return value if 1 <= (value := number(e + 8, 2)) <= 8 else 1
            return 1
        at += 2 + size
    return 1


def upright(img: np.ndarray, orientation: int) -> np.ndarray:
    """An image turned and mirrored as its orientation asks."""
    img = img.swapaxes(0, 1) if orientation >= 5 else img
    rows, columns = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[orientation]
    return img[::rows, ::columns]


def photos(spark: SparkSession, *paths: str, side: int = 4000) -> DataFrame:
    """(path, image: width, height, data in RGBA) of photos as they should be seen: decoded by Spark, turned by their EXIF orientation, no longer than `side`."""
    from ..operators.images import shrink

    def orient(batches):
        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "orientation": [exif_orientation(bytes(c)) for c in pdf["head"]]})

    path = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    # The EXIF block stands before the picture; a segment has 64 KB at most, and what cameras put before it is short.
    heads = files(spark, *paths).select(path("path").alias("path"), F.substring("content", 1, 1 << 18).alias("head")).mapInPandas(orient, "path string, orientation int")
    decoded = images(spark, *paths).select(path("image.origin").alias("path"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))

    def show(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                bgr = np.frombuffer(bytes(r.data), np.uint8).reshape(r.h, r.w, r.n)
                rgba = np.dstack([*([bgr[..., 0]] * 3 if r.n == 1 else [bgr[..., k] for k in (2, 1, 0)]), bgr[..., 3] if r.n == 4 else np.full((r.h, r.w), 255, np.uint8)])
                img = np.ascontiguousarray(shrink(upright(rgba, int(r.orientation)), side)).astype(np.uint8)
                out.append({"width": img.shape[1], "height": img.shape[0], "data": img.tobytes()})
            yield pd.DataFrame({"path": pdf["path"], "image": out})

    return decoded.join(heads, "path").mapInPandas(show, "path string, image struct<width:int,height:int,data:binary>")


def unzip(content: bytes, most: int = MOST_BYTES) -> list[tuple[str, bytes]]:
    """The entries of an archive: stored or deflated ones, each of `most` bytes unpacked at most, whatever its header says."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"{info.filename}: compression method {info.compress_type}")
            with z.open(info) as f:
                data = f.read(most + 1)
            if len(data) > most:
                raise ValueError(f"{info.filename}: over {most} bytes")
            out.append((info.filename, data))
    return out


def entries(archives: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """archives (path, content): one row per entry. An archive that isn't one is an error."""

    def read(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for name, data in unzip(content, most):
                    yield pd.DataFrame({"path": [path], "name": [name], "content": [data]})

    return archives.select("path", "content").mapInPandas(read, ENTRIES)


def restore(unpacked: DataFrame, app: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folders, documents and pages of a backup's entries. Pages without both their images go; folder ids that don't exist become null; what is missing gets its default.

    The manifest is one JSON object, or one JSON object to a line, each with some of the documents or folders. Columns ocr, marcas and portada are variants.
    """
    lines = unpacked.where("name = 'respaldo.json'").select("path", F.explode(F.split(F.col("content").cast("string"), "\n(?=\\{)")).alias("line"))
    manifest = lines.select("path", F.from_json("line", MANIFEST).alias("m")).where(F.col("m.app") == app)
    folders = manifest.select("path", F.inline("m.carpetas")).where("coalesce(id, '') <> '' AND coalesce(nombre, '') <> ''")
    docs = manifest.select("path", F.inline("m.documentos"))
    listed = docs.select("path", F.col("id").alias("doc_id"), F.posexplode("paginas").alias("pos", "p")).select("path", "doc_id", "pos", "p.*")
    blobs = unpacked.select("path", "name", "content")
    image = lambda c: blobs.select("path", F.col("name").alias(c), F.col("content").alias(f"{c}_bytes"))
    pages = listed.join(image("original"), ["path", "original"]).join(image("procesada"), ["path", "procesada"])
    pages = pages.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, (_, v) in PAGE_FIELDS.items() if v is not None})
    there = folders.select("path", F.col("id").alias("_folder")).distinct()
    kept = pages.groupBy("path", F.col("doc_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.col("id").alias("page")))), lambda x: x["page"]).alias("paginas"))
    out = docs.drop("paginas").join(there, (docs["path"] == there["path"]) & (docs["carpetaId"] == F.col("_folder")), "left").select(docs["path"], "id", "nombre", "creado", "modificado", F.col("_folder").alias("carpeta_id"))
    return folders, out.join(kept, ["path", "id"], "left").withColumn("paginas", F.coalesce("paginas", F.array().cast("array<string>"))), pages


def jpeg_size(data: bytes) -> tuple[int, int, int] | None:
    """(width, height, channels) from a JPEG's frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        kind, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height, data[at + 9]
        at += 2 + size
    return None


def jpeg_sizes():
    def of(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_size(bytes(c)) or (None, None, None) for c in content], columns=["width", "height", "channels"])

    return F.pandas_udf(of, "width int, height int, channels int")


def crc32(content: Column) -> Column:
    return F.crc32(content)

