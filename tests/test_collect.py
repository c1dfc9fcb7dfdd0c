"""The scan of pages with all that it unites: originals by srcset and by elements, readers, captured items, nested roots."""

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import collect, graph

PAGES = [
    (1, "https://boards.4chan.org/g/1", '<div class="file"><a class="fileThumb" href="//i.4cdn.org/g/17.webm"><img src="//i.4cdn.org/g/17s.jpg" width="10" height="10"></a></div>'),
    (2, "https://www.site.example/", '<img src="https://img.magnific.com/a.jpg?w=740" srcset="https://img.magnific.com/a.jpg?w=2000&amp;x=1 2000w">'),
    (3, "https://imgur.com/gallery/x", '<script>window.postDataJSON={"media":[{"id":"a","url":"https://i.imgur.com/a.png"},{"id":"b","url":"https://i.imgur.com/b.mp4"}]};</script>'),
    (4, "https://www.facebook.com/photo/?fbid=77", "<p>nothing</p>"),
    (5, "https://a.example/x/", '<img src="1.png"><img src="../x/1.png"><a href="v.mp4"><img src="t.jpg"></a><a href="https://9gag.com/gag/aa1">g</a>'),
    (5, "https://b.example/y/", '<img src="2.png"><article><video src="https://b.example/z.mp4"></video><a href="https://9gag.com/gag/aa2">g</a></article>'),
    (6, None, '<img src="rel.png"><img src="https://c.example/abs.png">'),
    (7, "https://x.com/u", '<a href="/u/status/123/photo/1">1</a><a href="/u/status/123/photo/1">2</a><a href="/u/status/9/video/1"><img src="https://pbs.twimg.com/media/q.jpg"></a>'),
    (8, "https://d.example/p", '<a href="/album/1"><img src="/th/1.jpg" width="100" height="80"></a><a href="/tags/x"><img src="/th/2.jpg"></a>'),
    (9, "https://e.example/", None),
    (None, "https://f.example/", '<meta property="og:video" content="/v.mp4"><meta property="og:image" content="/v.jpg"><video><source src="w.webm" type="video/webm"></video><noscript><img src="/n.png"></noscript>'),
]


@pytest.fixture(scope="module")
def scanned(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("src", F.lit("clash"))
    body = '{"id":"77","i":{"uri":"https://x.fbcdn.net/l.jpg","width":900,"height":800}}'
    captured = graph.captured_media(spark.createDataFrame([(1, "facebook", None, body)], "payload_id long, platform string, request_url string, body string"))
    got = {}
    for r in collect.media(pages, captured=captured).orderBy("page_id", "seq").collect():
        got.setdefault(r["page_id"], []).append(r)
    return got


def seen(scanned, page, *fields):
    return [tuple(r[f] for f in ("src", *fields)) for r in scanned.get(page, [])]


def test_originals(scanned):
    # as an image's original and as a link, the file is one item
    assert seen(scanned, 1, "kind", "media_key", "type") == [("https://i.4cdn.org/g/17.webm", "video", "4chan 17", "webm")]
    assert [(x, w) for x, w in seen(scanned, 2, "width")] == [("https://img.magnific.com/a.jpg?w=2000&x=1", 2000)]


def test_readers_and_captured_items(scanned):
    assert seen(scanned, 3, "kind", "media_key", "type") == [("https://i.imgur.com/a.png", "image", "imgur a", "png"), ("https://i.imgur.com/b.mp4", "video", "imgur b", "mp4")]
    assert seen(scanned, 4, "kind", "media_key", "width", "height") == [("https://x.fbcdn.net/l.jpg", "image", "fb:77", 900, 800)]


def test_every_row_is_a_page(scanned):
    assert sorted(seen(scanned, 5, "kind")) == sorted([
        ("https://a.example/x/1.png", "image"), ("https://a.example/x/t.jpg", "image"), ("https://a.example/x/v.mp4", "video"),
        ("https://b.example/y/2.png", "image"), ("https://b.example/z.mp4", "video"), ("https://9gag.com/gag/aa2", "video"),
    ])
    assert seen(scanned, 6) == [("https://c.example/abs.png",)]
    assert 9 not in scanned


def test_statuses_and_metadata(scanned):
    assert seen(scanned, 7, "kind", "hint") == [("https://pbs.twimg.com/media/q.jpg", "image", None), ("https://x.com/u/status/123/photo/1", "image", "photo 123 1")]
    got = seen(scanned, None, "kind", "type", "poster")
    assert got == [("https://f.example/w.webm", "video", "webm", None), ("https://f.example/n.png", "image", "png", None), ("https://f.example/v.jpg", "image", "jpeg", None), ("https://f.example/v.mp4", "video", "mp4", "https://f.example/v.jpg")]


def test_gallery_pages(spark):
    pages = spark.createDataFrame([p for p in PAGES if p[0] == 8], "page_id long, url string, html string")
    got = [(r["src"], r["platform"], r["unresolved_image"]) for r in collect.media(pages, resolve_originals=True).orderBy("seq").collect()]
    assert got == [("https://d.example/th/2.jpg", None, None), ("https://d.example/album/1", "gallery-page", True)]
    assert collect.media(pages.where("false")).count() == 0
