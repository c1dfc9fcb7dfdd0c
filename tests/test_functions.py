"""URL and scalar functions on stated cases."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from lumenweft.functions import cdn
from lumenweft.functions import scalar as S
from lumenweft.functions import url as U


def each(spark, cases, f):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", f(F.col("x")).alias("y"))
    got = [r["y"] for r in df.orderBy("i").collect()]
    assert got == [c[1] for c in cases]


CAP = "x." + base64.urlsafe_b64encode(json.dumps([[{"width": "<=1920", "height": "<=1080"}]]).encode()).decode().rstrip("=") + ".y"
UPGRADES = [
    ("https://pbs.twimg.com/media/A?format=jpg&name=small", "https://pbs.twimg.com/media/A?format=jpg&name=orig"),
    ("https://cdn.shopify.com/s/files/a_800x600.jpg?v=1&width=20", "https://cdn.shopify.com/s/files/a.jpg?v=1"),
    ("https://res.cloudinary.com/d/image/upload/w_400,c_fill/v1/mac_photos/x.jpg", "https://res.cloudinary.com/d/image/upload/v1/mac_photos/x.jpg"),
    ("https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/X.jpg/320px-X.jpg", "https://upload.wikimedia.org/wikipedia/commons/a/ab/X.jpg"),
    ("https://thumbs2.imgbox.com/aa/bb/cc_t.jpg", "https://images2.imgbox.com/aa/bb/cc_o.jpg"),
    ("https://blog.example.com/wp-content/uploads/a-300x200.jpg?w=3", "https://blog.example.com/wp-content/uploads/a.jpg"),
    ("https://cdn-icons-png.flaticon.com/128/1/2.png", "https://cdn-icons-png.flaticon.com/512/1/2.png"),
    ("https://assets.adidas.com/images/w_600,f_auto/a.jpg", "https://assets.adidas.com/images/w_1920,f_auto/a.jpg"),
    (f"https://images-wixmp-1.wixmp.com/f/a/v1/fit/w_300,h_200/n.jpg?token={CAP}", f"https://images-wixmp-1.wixmp.com/f/a/v1/fill/w_1920,h_1080,q_100,strp/n.jpg?token={CAP}"),
    ("https://ex.org/iiif/id/full/200,/0/default.jpg", "https://ex.org/iiif/id/full/full/0/default.jpg"),
    ("https://wsrv.nl/?url=i.example.com/a.jpg", "https://i.example.com/a.jpg"),
    ("https://c1.neweggimages.com/productimagecompressall300/a.jpg", "https://c1.neweggimages.com/productimagecompressall1280/a.jpg"),
    ("https://image.civitai.com/x/id/width=450/a.jpeg", "https://image.civitai.com/x/id/original=true/a.jpeg"),
    ("https://static.toiimg.com/photo/123.cms", "https://static.toiimg.com/thumb/msid-123,width-20000,resizemode-4/123.jpg"),
    ("https://www.ikea.com/images/a.jpg?f=s", "https://www.ikea.com/images/a.jpg?imwidth=2000"),
    ("https://example.com/a.jpg?x=1", "https://example.com/a.jpg?x=1"),
    ("not a url", "not a url"),
]


def test_upgrades(spark):
    got = {r["url"]: r["original"] for r in cdn.upgraded(spark.createDataFrame([(u,) for u, _ in UPGRADES], "url string")).collect()}
    assert got == dict(UPGRADES)
    assert len(cdn.RULES) == 95


@pytest.mark.parametrize("cases, f", [
    ([("https://scontent-a.fbcdn.net/v/x.jpg?oh=1", "fbcdn.net/v/x.jpg"), ("https://A.example.com/p.php?id=2&T=5&a=1", "a.example.com/p.php?a=1&id=2"), ("https://i.pinimg.com/236x/aa/b.jpg", "i.pinimg.com/aa/b.jpg"),
      ("https://gravatar.com/avatar/1?s=52", "gravatar.com/avatar/1"), ("zzz", "zzz"), ("https://x.imgix.net/a?w=3&page=2", "x.imgix.net/a?page=2"), ("https://res.cloudinary.com/d/image/upload/w_4,c_fill/v1234567890/a.jpg", "res.cloudinary.com/d/image/upload/a.jpg")], U.canonical_key),
    ([("a/../b\\c:?*.. /con.jpg", "a/b/c/_con.jpg"), ("", ""), ("..", ""), ("x" * 300 + ".jpeg", "x" * 195 + ".jpeg")], U.sanitize_path),
    ([("http://127.0.0.1/", False), ("http://2130706433/", False), ("http://0x7f000001/a", False), ("https://example.com/", True), ("http://[::1]/", False), ("http://10.0.0.1.nip.io/", False), ("http://8.8.8.8/", True),
      ("ftp://a.b/", False), ("http://foo.local", False), ("http://[2606:4700::1111]/", True), ("http://127-0-0-1.x.com", False)], U.safe_capture),
    ([("www.bbc.co.uk", "bbc.co.uk"), ("a.b.c.example.com", "example.com"), ("localhost", "localhost"), ("", "")], U.registrable_domain),
    ([("https://a.com/x.JPG?y", "jpeg"), ("https://a.com/x", "unknown"), ("a.tiff", "unknown")], U.image_type),
    ([("https://a.com/b?Token=1&x=2&X-Amz-Date=3#f", "https://a.com/b?x=2#f"), ("https://a.com/b?x=2", "https://a.com/b?x=2"), ("zz", "zz")], U.strip_secrets),
    ([("a/./b/../c", "a/c"), ("../x", None), ("/abs", None)], U.contained),
    ([("https://a.com/q%20w.tar.gz", "q w.tar"), ("data:image/png;base64,xx", None), ("https://a.com/", None)], U.original_name),
    ([("java\nscript:x", None), (" https://a.b/c ", "https://a.b/c")], U.safe_source),
    ([("PT1H2M3.5S", 3723.5), ("PT", 0.0), ("P1D", 0.0), ("PT10S", 10.0)], S.iso_seconds),
    ([("it's", "'it'\\''s'")], S.shell_quote),
])
def test_cases(spark, cases, f):
    each(spark, cases, f)


def test_canonical_key_is_idempotent_on_http_form(spark):
    urls = [(u,) for u, _ in UPGRADES if u.startswith("http")]
    df = spark.createDataFrame(urls, "u string").select(U.canonical_key(F.col("u")).alias("k")).select("k", U.canonical_key(F.concat(F.lit("https://"), F.col("k"))).alias("again"))
    assert all(r["k"] == r["again"] for r in df.collect())
