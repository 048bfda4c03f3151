"""The image source: a binaryFile scan of root/<subject>/[<split>/]file, with statuses and sizes from the files' headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galleria.functions import expr as X
from galleria.operators.catalog import derived, problems

# Image suffixes, split folder names and names that are not images of anyone.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp")
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "test": "test", "testing": "test"}
JUNK_NAMES = ("thumbs.db", "desktop.ini")


def not_hidden(name) -> F.Column:
    """No leading full stop, no archive leftovers, no folder files of desktops."""
    return ~(name.startswith(".") | name.startswith("__MACOSX") | F.lower(name).isin(*JUNK_NAMES))


def parse_paths(files: DataFrame, root: str) -> DataFrame:
    """image_id, subject, orig_split, ext and whether the name counts, from the `path` column."""
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), "^" + "/+".join(["", *[p for p in root.strip("/").split("/")]]) + "/+", "")
    parts = F.split(rel, "/")
    alias = F.create_map(*[x for k, v in SPLIT_ALIASES.items() for x in (F.lit(k), F.lit(v))])
    split = F.when(F.size(parts) > 2, F.coalesce(alias[F.lower(F.element_at(parts, 2))], F.lit(""))).otherwise(F.lit(""))
    shown = F.forall(parts, not_hidden)
    return files.withColumns({"image_id": rel, "subject": F.element_at(parts, 1), "orig_split": split, "ext": F.lower(F.regexp_extract(rel, r"\.([^./]+)$", 1)), "shown": shown & (F.size(parts) > 1)})


def image_size(raw: bytes) -> tuple[int, int, bool] | None:
    """(width, height, whether the file ends early) of PNG, GIF, BMP, WEBP, TIFF and JPEG headers; EXIF turns are applied. None:
    unreadable. Whether a TIFF ends early is not told by its header."""
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        w, h = struct.unpack(">II", raw[16:24])
        return w, h, b"IEND" not in raw[-16:]
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        w, h = struct.unpack("<HH", raw[6:10])
        return w, h, raw[-1:] != b";"
    if raw[:2] == b"BM" and len(raw) >= 26:
        w, h = struct.unpack("<ii", raw[18:26])
        return w, abs(h), len(raw) < struct.unpack("<I", raw[2:6])[0]
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP":
        return webp_size(raw)
    if raw[:4] in (b"II*\0", b"MM\0*"):
        tags = tiff_tags(raw)
        if 256 not in tags or 257 not in tags:
            return None
        return (tags[257], tags[256], False) if 5 <= tags.get(274, 1) <= 8 else (tags[256], tags[257], False)
    if raw[:2] != b"\xff\xd8":
        return None
    at, turned = 2, False
    while at + 9 < len(raw):
        if raw[at] != 0xFF:
            return None
        kind = raw[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if kind == 0xE1 and raw[at + 4 : at + 10] == b"Exif\0\0":
            turned = exif_turns(raw[at + 10 : at + 2 + size])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[at + 5 : at + 9])
            return (h, w, raw[-2:] != b"\xff\xd9") if turned else (w, h, raw[-2:] != b"\xff\xd9")
        at += 2 + size
    return None


def webp_size(raw: bytes) -> tuple[int, int, bool] | None:
    """Size of the first chunk of a WEBP: lossy, lossless or extended; an EXIF chunk may turn the last."""
    kind, cut = raw[12:16], len(raw) < 8 + int.from_bytes(raw[4:8], "little")
    le = lambda a, b: int.from_bytes(raw[a:b], "little")
    if kind == b"VP8 " and len(raw) >= 30 and raw[23:26] == b"\x9d\x01\x2a":
        return le(26, 28) & 0x3FFF, le(28, 30) & 0x3FFF, cut
    if kind == b"VP8L" and len(raw) >= 25 and raw[20] == 0x2F:
        bits = le(21, 25)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, cut
    if kind != b"VP8X" or len(raw) < 30:
        return None
    w, h, at = le(24, 27) + 1, le(27, 30) + 1, 30
    while at + 8 <= len(raw):
        size = le(at + 4, at + 8)
        if raw[at : at + 4] == b"EXIF":
            body = raw[at + 8 : at + 8 + size]
            return (h, w, cut) if exif_turns(body.removeprefix(b"Exif\0\0")) else (w, h, cut)
        at += 8 + size + size % 2
    return w, h, cut


def tiff_tags(tiff: bytes) -> dict[int, int]:
    """The first value of each short or long tag of the first directory."""
    if len(tiff) < 14:
        return {}
    order, out = "<" if tiff[:2] == b"II" else ">", {}
    at = struct.unpack(order + "I", tiff[4:8])[0]
    if at + 2 > len(tiff):
        return {}
    for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind = struct.unpack(order + "HH", entry[:4])
        if kind in (3, 4):
            out[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8 : 10 if kind == 3 else 12])[0]
    return out


def exif_turns(tiff: bytes) -> bool:
    """Whether the EXIF orientation swaps width and height (5 to 8)."""
    return 5 <= tiff_tags(tiff).get(0x0112, 1) <= 8


def _probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        width, height, status, cut = [], [], [], []
        for raw in pdf["content"]:
            got = image_size(bytes(raw)) if len(raw) else None
            width.append(float(got[0]) if got else None)
            height.append(float(got[1]) if got else None)
            cut.append(bool(got and got[2]))
            status.append("empty_file" if not len(raw) else "corrupt: unreadable header" if got is None else "zero_size" if 0 in got[:2] else "truncated" if got[2] else "ok")
        yield pdf.drop(columns="content").assign(width=width, height=height, status=status, truncated=cut)


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Files without content, which the binaryFile source passes over: (path, length, content)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    files, found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        if f.getLen() == 0:
            found.append((f.getPath().toString(), 0, b""))
    return spark.createDataFrame(found, "path string, length long, content binary")


def scan_dataset(spark: SparkSession, root: str, keep_truncated: bool = False, tiny_below: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, subjects, problems) of a folder tree; digests and lengths are computed by Spark, sizes from file headers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "content")
    files = files.filter("length > 0").unionByName(empty_files(spark, root))
    named = parse_paths(files, root).filter("shown")
    is_image = F.col("ext").isin(*EXTENSIONS)
    rows = named.filter(is_image).select("image_id", "subject", "orig_split", F.col("length").alias("file_bytes"), F.when(F.col("length") > 0, F.md5("content")).otherwise("").alias("md5"), "content")
    schema = "image_id string, subject string, orig_split string, file_bytes long, md5 string, width double, height double, status string, truncated boolean"
    images = rows.mapInPandas(_probe, schema)
    if keep_truncated:
        images = images.withColumn("status", F.when(F.col("status") == "truncated", "ok").otherwise(F.col("status")))
    images = derived(images, tiny_below)
    n = images.groupBy("subject").agg(F.count("*").alias("n_images"))
    subjects = n.withColumn("natural", X.natural_key(F.col("subject")))
    from pyspark.sql import Window

    subjects = subjects.withColumn("order", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("natural", "subject")) - 1).drop("natural")
    other = named.filter(~is_image).select("image_id", F.lit("not an image").alias("problem"))
    return images, subjects, problems(images).unionByName(other)


def scan_external(spark: SparkSession, root: str) -> DataFrame:
    return scan_dataset(spark, root, keep_truncated=True)[0].filter("status = 'ok'")
