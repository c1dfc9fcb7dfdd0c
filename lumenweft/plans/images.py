"""Queries over image files that are made from the documents table: each document's whole text is the XMP packet of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweft.functions import binary as B

#: What a segment of a JPEG holds beside the name of its kind.
SEGMENT = 65_533 - len(B.XMP_SPACE)


def _raw(x: bytes) -> Column:
    return F.lit(bytearray(x))


def _sized(value: Column, size: int = 4, little: bool = False) -> Column:
    bits = F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))
    return F.concat(*[F.substring(bits, k, 1) for k in range(size, 0, -1)]) if little else bits


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and file: PNG, JPEG, WebP and AVIF in turn, every third one moving; a text too long for a segment is a JPEG's pixels."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    no, text, size, moves = F.col("doc_id"), F.col("t"), F.octet_length("t"), F.col("doc_id") % 3 == 0
    tiff = F.concat(_raw(b"MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01"), _sized(no % 8 + 1, 2), _raw(b"\0\0"))
    crc = _raw(bytes(4))
    pixels = _raw(b"\0\0\0\x01IDATx" + bytes(4) + bytes(4) + b"IEND" + bytes(4))
    png = F.concat(
        _raw(B.PNG + b"\0\0\0\x0dIHDR" + bytes(17)), _sized(size + 22), _raw(b"iTXt" + B.XMP_KEYWORD + bytes(4)), text, crc, F.when(moves, _raw(b"\0\0\0\x08acTL" + bytes(12))).otherwise(_raw(b"")), _raw(b"\0\0\0\x16eXIf"), tiff, crc, pixels,
    )
    packet = F.when(size <= SEGMENT, F.concat(_raw(b"\xff\xe1"), _sized(size + len(B.XMP_SPACE) + 2, 2), _raw(B.XMP_SPACE), text)).otherwise(_raw(b""))
    jpeg = F.concat(_raw(b"\xff\xd8\xff\xe1\0\x1e" + B.EXIF), tiff, packet, _raw(b"\xff\xda\0\x02"), F.when(size > SEGMENT, text).otherwise(_raw(b"x")), _raw(b"\xff\xd9"))
    webp = F.concat(
        _raw(b"RIFF"), _sized(size + size % 2 + 60, little=True), _raw(b"WEBPVP8X\x0a\0\0\0"), F.when(moves, _raw(b"\x0e")).otherwise(_raw(b"\x0c")), _raw(bytes(9) + b"EXIF\x16\0\0\0"), tiff, _raw(b"XMP "), _sized(size, little=True), text,
        F.when(size % 2 == 1, _raw(b"\0")).otherwise(_raw(b"")),
    )
    # the items' bytes follow boxes of 158 bytes
    items = b"\0\0\0\x4aiinf\0\0\0\0\0\x02" + b"\0\0\0\x14infe\x02\0\0\0\0\x01\0\0Exif" + b"\0\0\0\x28infe\x02\0\0\0\0\x02\0\0mime" + B.RDF + b"\0"
    places = b"\0\0\0\x2ciloc\0\0\0\0\x44\0\0\x02" + b"\0\x01\0\0\0\x01\0\0\0\x9e\0\0\0\x1a" + b"\0\x02\0\0\0\x01\0\0\0\xb8"
    avif = F.concat(_raw(b"\0\0\0\x14ftypavif\0\0\0\0"), F.when(moves, _raw(b"avis")).otherwise(_raw(b"mif1")), _raw(b"\0\0\0\x82meta\0\0\0\0" + items + places), _sized(size), _sized(size + 34), _raw(b"mdat" + bytes(4)), tiff, text)
    return d.select("doc_id", F.when(no % 4 == 0, png).when(no % 4 == 1, jpeg).when(no % 4 == 2, webp).otherwise(avif).alias("file"))


_PNG = B.PNG + b"\0\0\0\x0dIHDR" + bytes(17) + b"\0\0\0\0IEND" + bytes(4)
_JPEG = b"\xff\xd8\xff\xda\0\x02x\xff\xd9"


def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the file of each document says, and the PNG or JPEG that it is converted to with its metadata: its size and whether the same is read from it; null where it does not fit."""
    png = F.floor(F.col("doc_id") / 4) % 2 == 0
    files = image_files(spark, sf_dir).select("doc_id", B.container(F.col("file")).alias("container"), B.animated(F.col("file")).alias("animated"), B.metadata(F.col("file")).alias("m"))
    out = F.when(png, B.with_metadata(_raw(_PNG), "png", F.col("m"))).otherwise(B.with_metadata(_raw(_JPEG), "jpeg", F.col("m")))
    same = lambda back: back["exif"].eqNullSafe(F.col("m.exif")) & back["xmp"].eqNullSafe(F.col("m.xmp"))
    return files.withColumn("out", out).select(
        "doc_id", "container", "animated", B.orientation(F.col("m.exif")).alias("orientation"), F.sha2("m.xmp", 256).alias("xmp_sha256"), F.octet_length("out").cast("bigint").alias("copied_bytes"),
        F.when(F.col("out").isNotNull(), B.let(B.metadata(F.col("out")), same)).alias("copied_same"),
    )


QUERIES = {"image_headers": image_headers}
ORACLES = {
    "image_headers": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
x AS (SELECT *, doc_id % 4 <> 1 OR n <= {SEGMENT} AS packet, doc_id // 4 % 2 = 0 AS png FROM d)
SELECT doc_id, (['png', 'jpeg', 'webp', 'isobmff'])[doc_id % 4 + 1] AS container, doc_id % 3 = 0 AND doc_id % 4 <> 1 AS animated, CAST(doc_id % 8 + 1 AS INTEGER) AS orientation, CASE WHEN packet THEN sha256(t) END AS xmp_sha256,
  CAST(CASE WHEN png THEN 45 + 34 + CASE WHEN packet THEN 34 + n ELSE 0 END WHEN NOT packet OR n <= {SEGMENT} THEN 9 + 32 + CASE WHEN packet THEN 33 + n ELSE 0 END END AS BIGINT) AS copied_bytes, CASE WHEN png OR NOT packet OR n <= {SEGMENT} THEN true END AS copied_same FROM x""",
}
