"""Headers of images: made files of each container, broken ones, and files read back after metadata was put in."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenweft.functions import binary as B

TIFF = b"MM\0*\0\0\0\x08\0\x02\x01\x00\0\x03\0\0\0\x01\0\x05\0\0\x01\x12\0\x03\0\0\0\x01\0\x06\0\0"
TIFF_LE = b"II*\0\x08\0\0\0\x01\0\x12\x01\x03\0\x01\0\0\0\x03\0\0\0"
XMP = "<x:xmpmeta>é\0</x:xmpmeta>".encode()


def chunk(name, body=b"", crc=None):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body) if crc is None else crc)


def png(*chunks, end=True):
    return B.PNG + chunk(b"IHDR", bytes(13)) + b"".join(chunks) + (chunk(b"IEND") if end else b"")


def itxt(body, flag=b"\0", language=b"", keyword=b"XML:com.adobe.xmp"):
    return chunk(b"iTXt", keyword + b"\0" + flag + b"\0" + language + b"\0" + b"\0" + body)


def segment(marker, body):
    return b"\xff" + bytes([marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\0\x02pixels\xff\xd9"


def riff(*chunks):
    body = b"WEBP" + b"".join(n + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for n, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def avif(brands=(b"avif", b"mif1"), exif=None, xmp=None, iloc=0, infe=2):
    """One box of each kind; the items' bytes lie at the end of the file."""
    head = box(b"ftyp", brands[0] + bytes(4) + b"".join(brands))
    if exif is None and xmp is None:
        return head + box(b"mdat", b"pixels")
    items = [(k, v) for k, v in ((b"Exif", exif and bytes(4) + exif), (b"mime" + B.RDF + b"\0", xmp)) if v is not None]
    ids = 2 if infe == 2 else 4
    entry = lambda no, kind: box(b"infe", bytes([infe, 0, 0, 0]) + no.to_bytes(ids, "big") + b"\0\0" + kind)
    iinf = box(b"iinf", bytes(4) + struct.pack(">H", len(items)) + b"".join(entry(no + 1, k) for no, (k, _) in enumerate(items)))

    def meta(base):
        wide = iloc >= 2
        rows = b""
        for no, (_, body) in enumerate(items):
            rows += (no + 1).to_bytes(4 if wide else 2, "big") + (b"\0\0" if iloc in (1, 2) else b"") + b"\0\0" + struct.pack(">I", 3) + b"\0\x02" + struct.pack(">II", base - 3, len(body)) + struct.pack(">II", 9, 9)
            base += len(body)
        loc = bytes([iloc, 0, 0, 0]) + b"\x44\x40" + len(items).to_bytes(4 if wide else 2, "big") + rows
        return box(b"meta", bytes(4) + box(b"hdlr", bytes(20)) + iinf + box(b"iloc", loc))

    size = len(head) + len(meta(3)) + 8
    return head + meta(size) + box(b"mdat", b"".join(b for _, b in items))


FILES = {
    # name: (file, container, animated, exif, xmp)
    "png": (png(chunk(b"IDAT", b"x")), "png", False, None, None),
    "apng": (png(chunk(b"acTL", bytes(8)), chunk(b"IDAT", b"x")), "png", True, None, None),
    "late control": (png(chunk(b"IDAT", b"x"), chunk(b"acTL", bytes(8))), "png", False, None, None),
    "control after many": (png(*[chunk(b"tEXt", b"a")] * 300, chunk(b"acTL")), "png", True, None, None),
    "long chunk": (B.PNG + b"\xff\xff\xff\xffabcd" + chunk(b"acTL"), "png", False, None, None),
    "longest chunk": (B.PNG + b"\x7f\xff\xff\xffabcd" + chunk(b"acTL"), "png", False, None, None),
    "png both": (png(itxt(XMP, language=b"de"), chunk(b"eXIf", TIFF), chunk(b"eXIf", b"second"), itxt(b"second")), "png", False, TIFF, XMP),
    "png after pixels": (png(chunk(b"IDAT", bytes(5000)), chunk(b"eXIf", TIFF)), "png", False, TIFF, None),
    "png compressed": (png(itxt(XMP, flag=b"\x01")), "png", False, None, None),
    "png other text": (png(itxt(XMP, keyword=b"Comment")), "png", False, None, None),
    "png text without end": (png(chunk(b"iTXt", b"XML:com.adobe.xmp\0\0\0de")), "png", False, None, None),
    "png after the end": (png() + chunk(b"eXIf", TIFF), "png", False, None, None),
    "png cut": (png(chunk(b"eXIf", TIFF), end=False)[:-2], "png", False, None, None),
    "jpeg": (jpeg(segment(0xE0, b"JFIF\0"), segment(0xE1, B.EXIF + TIFF), segment(0xE1, B.XMP_SPACE + XMP), segment(0xE1, B.EXIF + b"second")), "jpeg", False, TIFF, XMP),
    "jpeg empty exif": (jpeg(segment(0xE1, B.EXIF), segment(0xE1, B.EXIF + TIFF)), "jpeg", False, b"", None),
    "jpeg after pixels": (jpeg() + segment(0xE1, B.EXIF + TIFF), "jpeg", False, None, None),
    "jpeg cut": (b"\xff\xd8" + segment(0xE1, B.EXIF + TIFF)[:-1], "jpeg", False, None, None),
    "webp": (riff((b"VP8X", b"\x0c" + bytes(9)), (b"ODD ", b"abc"), (b"EXIF", B.EXIF + TIFF), (b"XMP ", XMP)), "webp", False, TIFF, XMP),
    "webp bare exif": (riff((b"VP8X", b"\x02" + bytes(9)), (b"EXIF", TIFF_LE)), "webp", True, TIFF_LE, None),
    "webp plain": (riff((b"VP8 ", b"\x02" * 30)), "webp", False, None, None),
    "webp short": (riff((b"VP8X", b""))[:20], "webp", False, None, None),
    "avif": (avif(), "isobmff", False, None, None),
    "avif sequence": (avif((b"avis", b"mif1")), "isobmff", True, None, None),
    "avif late brand": (avif((b"mif1", b"heic", b"avis")), "isobmff", True, None, None),
    "avif both": (avif(exif=TIFF, xmp=XMP), "isobmff", False, TIFF, XMP),
    "avif wide": (avif(exif=TIFF, xmp=XMP, iloc=2, infe=3), "isobmff", False, TIFF, XMP),
    "avif middle": (avif(exif=TIFF_LE, iloc=1), "isobmff", False, TIFF_LE, None),
    "avif cut": (avif(exif=TIFF)[:-1], "isobmff", False, None, None),
    "short box": (b"\0\0\0\x09ftypavis", "isobmff", False, None, None),
    "negative box": (b"\xff\0\0\x09ftypavis", "isobmff", False, None, None),
    "none": (b"plain text", None, False, None, None),
    "empty": (b"", None, False, None, None),
    "null": (None, None, False, None, None),
}


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k, None if v[0] is None else bytearray(v[0])) for k, v in FILES.items()], "name string, file binary")
    got = df.select("name", B.container(F.col("file")).alias("c"), B.animated(F.col("file")).alias("a"), B.metadata(F.col("file")).alias("m"))
    return {r["name"]: r for r in got.collect()}


@pytest.mark.parametrize("name", FILES)
def test_made_files(read, name):
    _, kind, moves, exif, xmp = FILES[name]
    r = read[name]
    m = r["m"]
    plain = lambda x: None if x is None else bytes(x)
    assert (r["c"], r["a"], plain(m and m["exif"]), plain(m and m["xmp"])) == (kind, moves, exif, xmp)


def test_cut_anywhere(spark):
    """No file that ends early fails, and none gives other bytes than the whole one."""
    whole = {k: FILES[k][0] for k in ("png both", "jpeg", "webp", "avif wide", "apng")}
    rows = [(k, bytearray(b[:n])) for k, b in whole.items() for n in range(len(b))]
    df = spark.createDataFrame(rows, "name string, file binary").select("name", B.animated(F.col("file")).alias("a"), B.metadata(F.col("file")).alias("m"))
    for r in df.collect():
        _, _, moves, exif, xmp = FILES[r["name"]]
        assert moves or not r["a"]
        for got, want in ((r["m"] and r["m"]["exif"], exif), (r["m"] and r["m"]["xmp"], xmp)):
            assert got is None or bytes(got) == want


def test_orientation(spark):
    blocks = [TIFF, TIFF_LE, TIFF[:10], TIFF[:-2], TIFF[:8], b"", None, b"MM\0*\xff\xff\xff\xff", TIFF.replace(b"\0\x06\0\0", b"\0\x09\0\0"), b"XX" + TIFF[2:]]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(blocks)], "k int, exif binary")
    got = [r[0] for r in df.select("k", B.orientation(F.col("exif")).alias("o")).orderBy("k").select("o").collect()]
    assert got == [6, 3, None, 6, None, None, None, None, None, None]


BARE = {"png": png(chunk(b"IDAT", b"x")), "jpeg": jpeg()}


@pytest.mark.parametrize("target", ["png", "jpeg"])
def test_put_in_and_read_back(spark, target):
    cases = [(TIFF, XMP), (TIFF, None), (None, XMP), (None, None), (b"", b""), (None, b"x" * 65_504), (None, b"x" * 65_505), (b"y" * 65_528, None)]
    cell = lambda x: None if x is None else bytearray(x)
    rows = [(k, bytearray(BARE[target]), cell(e), cell(x)) for k, (e, x) in enumerate(cases)]
    rows += [(100, bytearray(b"other"), cell(TIFF), None), (101, None, cell(TIFF), None)]
    df = spark.createDataFrame(rows, "k int, file binary, exif binary, xmp binary").withColumn("out", B.with_metadata(F.col("file"), target, F.struct("exif", "xmp")))
    got = {r["k"]: r for r in df.withColumn("m", B.metadata(F.col("out"))).collect()}
    for k, (e, x) in enumerate(cases):
        if target == "jpeg" and (len(x or b"") > 65_504 or len(e or b"") > 65_527):
            assert got[k]["out"] is None
            continue
        m = got[k]["m"]
        assert (None if m["exif"] is None else bytes(m["exif"]), None if m["xmp"] is None else bytes(m["xmp"])) == (e, x)
        if target == "png" and e == TIFF:
            made = b"" if x is None else itxt(x)
            assert bytes(got[k]["out"]) == BARE["png"][:33] + chunk(b"eXIf", TIFF) + made + BARE["png"][33:]
    assert got[100]["out"] is None and got[101]["out"] is None
    assert bytes(got[3]["out"]) == BARE[target]
