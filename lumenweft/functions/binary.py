"""Headers of image files: containers, animation, embedded metadata, as expressions over a binary column.

Chunks, segments and boxes are walked by a fold over offsets inside the JVM, only the few bytes that a step asks for are cut
out. A null file, an empty one or one that ends early gives what was found up to there: false, or null for what is not there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenweft.functions.url import let

# Fixed values of the formats: signatures, names and keywords.
PNG = b"\x89PNG\r\n\x1a\n"
JPEG = b"\xff\xd8\xff"
EXIF = b"Exif\0\0"
XMP_SPACE = b"http://ns.adobe.com/xap/1.0/\0"
XMP_KEYWORD = b"XML:com.adobe.xmp\0"
RDF = b"application/rdf+xml"
ORIENTATION = 0x0112

PLACE = "struct<start:bigint,size:bigint>"


def _b(x: bytes) -> Column:
    return F.lit(bytearray(x))


def _int(x: Column) -> Column:
    return F.least(x.cast("bigint"), F.lit(2**31 - 1)).cast("int")


def cut(b: Column, start: Column, size) -> Column:
    """size bytes from start (from 0); fewer where the file ends."""
    return F.substring(b, _int(start + 1), _int(size) if isinstance(size, Column) else F.lit(size))


def number(bits: Column) -> Column:
    """Bytes as an unsigned number, the first the highest; null for none and for what 63 bits do not hold."""
    return F.conv(F.hex(bits), 16, 10).try_cast("bigint")


def _turned(b: Column, start: Column, size: int) -> Column:
    return F.concat(*[cut(b, start + (size - 1 - k), 1) for k in range(size)])


def _is(b: Column, start: Column, what: bytes) -> Column:
    return cut(b, start, len(what)) == _b(what)


def _size(b: Column) -> Column:
    return F.octet_length(b).cast("bigint")


def _place(start: Column, size: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.greatest(size, F.lit(0)).cast("bigint").alias("size"))


def _walk(first: dict[str, Column], step: Callable[[Column], dict[str, Column]], most: Column) -> Column:
    """The state after steps until done is true, at most `most` of them.

    Two folds inside each other of the root of `most` each: after the end a walk passes over two roots, not over all that is left.
    """
    names = ["done", *first]
    pack = lambda v: F.struct(*[v[n].alias(n) for n in names])
    go = lambda s, _: F.when(s["done"], s).otherwise(pack({n: s[n] for n in names} | step(s)))
    side = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.sqrt(most.cast("double")))).cast("int"))
    return F.aggregate(side, pack({"done": F.lit(False)} | first), lambda s, _: F.when(s["done"], s).otherwise(F.aggregate(side, s, go)))


def _none(kind: str = PLACE) -> Column:
    return F.lit(None).cast(kind)


def container(b: Column) -> Column:
    """jpeg, png, webp or isobmff (AVIF and HEIC) by the first bytes; else null."""
    zero = F.lit(0)
    webp = _is(b, zero, b"RIFF") & _is(b, zero + 8, b"WEBP")
    return F.when(_is(b, zero, JPEG), "jpeg").when(_is(b, zero, PNG), "png").when(webp, "webp").when(_is(b, zero + 4, b"ftyp") & (_size(b) >= 12), "isobmff")


def animated(b: Column) -> Column:
    """Whether a WebP has its animation flag, an AVIF the brand of sequences, or a PNG a control chunk before its pixels."""

    def of(b: Column) -> Column:
        n, zero = _size(b), F.lit(0).cast("bigint")
        flag = _is(b, zero + 12, b"VP8X") & (F.coalesce(number(cut(b, zero + 20, 1)), zero).bitwiseAND(2) != 0)
        box = F.least(number(cut(b, zero, 4)), n)
        # a length of more than 31 bits is a negative one there
        brands = F.when((box >= 12) & (number(cut(b, zero, 4)) < 1 << 31), F.sequence(F.lit(8).cast("bigint"), box - 4, F.lit(4).cast("bigint")))
        sequence = F.exists(F.coalesce(brands, F.array().cast("array<bigint>")), lambda o: _is(b, o, b"avis"))

        def step(s: Column) -> dict[str, Column]:
            o = s["o"]
            control, pixels, size = _is(b, o + 4, b"acTL"), _is(b, o + 4, b"IDAT"), number(cut(b, o, 4))
            over = o + 8 > n
            return {"done": over | control | pixels | (size >= 1 << 31), "hit": ~over & control, "o": o + 12 + size}

        png = _walk({"o": F.lit(8).cast("bigint"), "hit": F.lit(False)}, step, n / 12 + 1)["hit"]
        kind = container(b)
        return F.coalesce(F.when(kind == "webp", flag).when(_is(b, zero + 4, b"ftyp"), sequence).when(kind == "png", png), F.lit(False))

    return let(b, of)


def _kept(s: Column, exif: Column, exif_at: Column, xmp: Column, xmp_at: Column) -> dict[str, Column]:
    """The first of each kind stays."""
    return {"exif": F.when(s["exif"].isNull() & exif, exif_at).otherwise(s["exif"]), "xmp": F.when(s["xmp"].isNull() & xmp, xmp_at).otherwise(s["xmp"])}


def _in_jpeg(b: Column, n: Column) -> Column:
    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        size, marker = number(cut(b, o + 2, 2)), cut(b, o + 1, 1)
        start, end = o + 4, o + 2 + size
        over = (o + 4 > n) | ~_is(b, o, b"\xff") | marker.isin(bytearray(b"\xd9"), bytearray(b"\xda")) | (size < 2) | (end > n)
        app = ~over & (marker == _b(b"\xe1"))
        found = _kept(s, app & _is(b, start, EXIF), _place(start + 6, end - start - 6), app & _is(b, start, XMP_SPACE), _place(start + len(XMP_SPACE), end - start - len(XMP_SPACE)))
        return found | {"done": over, "o": end}

    return _walk({"o": F.lit(2).cast("bigint"), "exif": _none(), "xmp": _none()}, step, n / 4 + 1)


def _in_png(b: Column, n: Column) -> Column:
    def packet(start: Column, size: Column) -> Column:
        """Where the text of an uncompressed XMP chunk lies: after its keyword, two flags, a language and a translated keyword."""
        zero = F.lit("\0")
        tail = F.decode(cut(b, start + len(XMP_KEYWORD) + 2, size - len(XMP_KEYWORD) - 2), "ISO-8859-1")
        second = let(tail, lambda t: let(F.call_function("locate", zero, t), lambda p: F.when(p > 0, F.call_function("locate", zero, t, p + 1)).otherwise(0)))
        plain = _is(b, start, XMP_KEYWORD) & (size >= len(XMP_KEYWORD) + 4) & _is(b, start + len(XMP_KEYWORD), b"\0")
        return F.when(plain, let(second, lambda p: F.when(p > 0, _place(start + len(XMP_KEYWORD) + 2 + p, size - len(XMP_KEYWORD) - 2 - p))))

    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        size, kind = number(cut(b, o, 4)), cut(b, o + 4, 4)
        over = (o + 8 > n) | (o + 12 + size > n) | (kind == _b(b"IEND"))
        text = F.when(~over & s["xmp"].isNull() & (kind == _b(b"iTXt")), packet(o + 8, size))
        return _kept(s, ~over & (kind == _b(b"eXIf")), _place(o + 8, size), text.isNotNull(), text) | {"done": over, "o": o + 12 + size}

    return _walk({"o": F.lit(8).cast("bigint"), "exif": _none(), "xmp": _none()}, step, n / 12 + 1)


def _in_webp(b: Column, n: Column) -> Column:
    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        size, kind = number(_turned(b, o + 4, 4)), cut(b, o, 4)
        over = (o + 8 > n) | (o + 8 + size > n)
        skip = F.when(_is(b, o + 8, EXIF), 6).otherwise(0)
        return _kept(s, ~over & (kind == _b(b"EXIF")), _place(o + 8 + skip, size - skip), ~over & (kind == _b(b"XMP ")), _place(o + 8, size)) | {"done": over, "o": o + 8 + size + size % 2}

    return _walk({"o": F.lit(12).cast("bigint"), "exif": _none(), "xmp": _none()}, step, n / 8 + 1)


def _box(b: Column, start: Column, end: Column, name: bytes) -> Column:
    """Start and end of what the first box of that name holds after its version and flags; null without one."""

    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        short = number(cut(b, o, 4))
        head = F.when(short == 1, 16).otherwise(8)
        size = F.when(short == 1, number(cut(b, o + 12, 4))).otherwise(short)
        over = (o + head > end) | (size < head) | (o + size > end)
        hit = ~over & _is(b, o + 4, name)
        return {"done": over | hit, "o": o + size, "at": F.when(hit, F.struct((o + head + 4).alias("start"), (o + size).alias("end"))).otherwise(s["at"])}

    return _walk({"o": start, "at": _none("struct<start:bigint,end:bigint>")}, step, (end - start) / 8 + 1)["at"]


def _items(b: Column, at: Column) -> Column:
    """The metadata items of a file, in order: array of (id, kind)."""
    wide = number(cut(b, at["start"] - 4, 1)) >= 1

    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        size, version = number(cut(b, o, 4)), number(cut(b, o + 8, 1))
        over = (o + 8 > at["end"]) | (size < 8) | (o + size > at["end"])
        long_id = version > 2
        id = number(F.when(long_id, cut(b, o + 12, 4)).otherwise(cut(b, o + 12, 2)))
        p = o + F.when(long_id, 18).otherwise(16)
        kind = F.when(_is(b, p, b"Exif"), "exif").when(_is(b, p, b"mime") & _is(b, p + 4, RDF), "xmp")
        hit = ~over & _is(b, o + 4, b"infe") & (version >= 2) & kind.isNotNull()
        return {"done": over, "o": o + size, "all": F.when(hit, F.concat(s["all"], F.array(F.struct(id.alias("id"), kind.alias("kind"))))).otherwise(s["all"])}

    first = at["start"] + F.when(wide, 4).otherwise(2)
    return _walk({"o": first, "all": F.array().cast("array<struct<id:bigint,kind:string>>")}, step, (at["end"] - at["start"]) / 8 + 1)["all"]


def _locations(b: Column, at: Column) -> Column:
    """The first extent of each item: array of (id, start, size)."""
    o, zero = at["start"], F.lit(0).cast("bigint")
    version = number(cut(b, o - 4, 1))
    sizes = number(cut(b, o, 1))
    off, length, base = (sizes / 16).cast("int"), (sizes % 16).cast("int"), (number(cut(b, o + 1, 1)) / 16).cast("int")
    id_size = F.when(version < 2, 2).otherwise(4)
    count = number(cut(b, o + 2, id_size))
    field = lambda start, size: F.when(size == 0, zero).otherwise(number(cut(b, start, size)))

    def step(s: Column) -> dict[str, Column]:
        o = s["o"]
        over = (o >= at["end"]) | (s["k"] >= count)
        p = o + id_size + F.when(version.isin(1, 2), 4).otherwise(2)
        extents = number(cut(b, p + base, 2))
        q = p + base + 2
        place = F.struct(number(cut(b, o, id_size)).alias("id"), (field(p, base) + field(q, off)).alias("start"), field(q + off, length).alias("size"))
        return {"done": over, "o": q + extents * (off + length), "k": s["k"] + 1, "all": F.when(~over & (extents > 0), F.concat(s["all"], F.array(place))).otherwise(s["all"])}

    return _walk({"o": o + 2 + id_size, "k": zero, "all": F.array().cast("array<struct<id:bigint,start:bigint,size:bigint>>")}, step, count + 1)["all"]


def _in_boxes(b: Column, n: Column) -> Column:
    def first_of(kind: str, items: Column, places: Column) -> Column:
        def of(item: Column) -> Column:
            # of several places of an item the last counts
            at = F.try_element_at(F.filter(places, lambda x: x["id"] == item["id"]), F.lit(-1))
            fine = at["start"] + at["size"] <= n
            if kind == "xmp":
                return F.when(fine, _place(at["start"], at["size"]))
            skip = F.when(at["size"] >= 4, 4 + number(cut(b, at["start"], 4))).otherwise(0)
            return F.when(fine & (skip <= at["size"]), _place(at["start"] + skip, at["size"] - skip))

        return F.get(F.filter(F.transform(F.filter(items, lambda x: x["kind"] == kind), of), lambda x: x.isNotNull()), F.lit(0))

    def inside(meta: Column) -> Column:
        both = F.struct(_box(b, meta["start"], meta["end"], b"iinf").alias("i"), _box(b, meta["start"], meta["end"], b"iloc").alias("l"))
        lists = let(both, lambda x: F.when(x["i"].isNotNull() & x["l"].isNotNull(), F.struct(_items(b, x["i"]).alias("items"), _locations(b, x["l"]).alias("places"))))
        return let(lists, lambda x: F.struct(first_of("exif", x["items"], x["places"]).alias("exif"), first_of("xmp", x["items"], x["places"]).alias("xmp")))

    return let(_box(b, F.lit(0).cast("bigint"), n, b"meta"), lambda m: F.when(m.isNotNull(), inside(m)))


def metadata(b: Column) -> Column:
    """exif and xmp, the bytes of the first EXIF block and of the first XMP packet in a file; null for what it does not hold."""

    def of(b: Column) -> Column:
        n, kind = _size(b), container(b)
        take = lambda x: F.struct(x["exif"].alias("exif"), x["xmp"].alias("xmp"))
        found = F.when(kind == "jpeg", take(_in_jpeg(b, n))).when(kind == "png", take(_in_png(b, n))).when(kind == "webp", take(_in_webp(b, n))).when(kind == "isobmff", take(_in_boxes(b, n)))
        part = lambda p: F.when(p.isNotNull(), cut(b, p["start"], p["size"]))
        return let(found, lambda f: F.struct(part(f["exif"]).alias("exif"), part(f["xmp"]).alias("xmp")))

    return let(b, of)


def orientation(exif: Column) -> Column:
    """The orientation (1 to 8) that the first directory of an EXIF block states; else null."""

    def of(x: Column) -> Column:
        little = _is(x, F.lit(0), b"II*\0")
        read = lambda at, size: number(F.when(little, _turned(x, at, size)).otherwise(cut(x, at, size)))

        def entries(first: Column) -> Column:
            count = F.least(read(first, 2), (_size(x) - first) / 12).cast("int")  # the last two bytes of an entry are not read
            places = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda k: first + 2 + k * 12))
            hits = F.filter(places, lambda p: (read(p, 2) == ORIENTATION) & (read(p + 2, 2) == 3))
            return let(read(F.get(hits, F.lit(0)) + 8, 2), lambda v: F.when(v.between(1, 8), v.cast("int")))

        return F.when(little | _is(x, F.lit(0), b"MM\0*"), let(read(F.lit(4), 4), entries))

    return let(exif, of)


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))


def _segment(prefix: bytes, body: Column) -> Column:
    size = F.octet_length(body) + len(prefix) + 2
    return F.when(size <= 0xFFFF, F.concat(_b(b"\xff\xe1"), _be(size, 2), _b(prefix), body))


def _chunk(name: bytes, body: Column) -> Column:
    return let(F.concat(_b(name), body), lambda x: F.concat(_be(F.octet_length(x) - 4, 4), x, _be(F.crc32(x), 4)))


def with_metadata(b: Column, target: str, meta: Column) -> Column:
    """The file (a jpeg or png, as target says) with meta's exif and xmp put in; as it is where both are null.

    Null where they do not fit (a segment of a JPEG holds 65,533 bytes), where the file is not of the target or is null.
    """
    bare, size = _b(b""), _size(b)
    part = lambda x, made: F.when(x.isNull(), bare).otherwise(made)
    if target == "jpeg":
        head = F.lit(2)
        fine = _is(b, F.lit(0), JPEG[:2])
        put = F.concat(part(meta["exif"], _segment(EXIF, meta["exif"])), part(meta["xmp"], _segment(XMP_SPACE, meta["xmp"])))
    elif target == "png":
        head = number(cut(b, F.lit(8), 4)) + 20
        fine = _is(b, F.lit(0), PNG) & (size >= 16) & (head <= size)
        put = F.concat(part(meta["exif"], _chunk(b"eXIf", meta["exif"])), part(meta["xmp"], _chunk(b"iTXt", F.concat(_b(XMP_KEYWORD + b"\0\0\0\0"), meta["xmp"]))))
    else:
        raise ValueError("target is jpeg or png")
    both = F.when(fine, F.concat(cut(b, F.lit(0), head), put, cut(b, head, size)))
    return F.when(meta["exif"].isNull() & meta["xmp"].isNull(), b).otherwise(both)
