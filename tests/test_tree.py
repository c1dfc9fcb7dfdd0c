"""Roots and intervals of elements, selectors, and originals that a page names beside its images."""

import random

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import extract, originals
from lumenweft.operators import tree as T

PAGES = "page_id long, url string, html string"


def test_intervals_of_elements():
    rows = extract.tokenise("<div id=a><p>x<b>y</b></p><img></div><i></i><u><s>")
    assert [(r[2], r[3], r[4], r[5]) for r in rows] == [(0, -1, 3, "div"), (1, 0, 2, "p"), (2, 1, 2, "b"), (3, 0, 3, "img"), (4, -1, 4, "i"), (5, -1, 6, "u"), (6, 5, 6, "s")]
    assert [r[7] for r in rows[:3]] == ["", "x", "y"]


def test_nested_roots_once_and_in_order():
    html = """<div><template shadowrootmode="open"><img id=s1><iframe srcdoc="<img id=f2><template shadowrootmode=open><img id=s3></template>"></iframe></template><img id=d1></div>
    <template><img id=inert></template><template shadowrootmode="closed"><img id=closed></template><iframe srcdoc='<p><img id=f1>'></iframe><p><template shadowrootmode=open><img id=s2></template></p><noscript><img id=n></noscript>"""
    rows = extract.tokenise(html)
    assert [r[2] for r in rows] == list(range(len(rows)))
    images = [(r[0], r[1], r[6]["id"]) for r in rows if r[5] == "img"]
    assert images == [(0, 0, "d1"), (1, 0, "s1"), (2, 0, "s2"), (3, 3, "f1"), (4, 4, "f2"), (5, 4, "s3")]
    spans = {r[2]: (r[0], r[4]) for r in rows}
    assert all(spans[x][0] == root for at, (root, last) in spans.items() for x in range(at, last + 1))


def test_enclosed_is_every_interval_around(spark):
    rng = random.Random(4)
    outer = [(p, a, a + rng.randrange(700)) for p in range(3) for a in (rng.randrange(1000) for _ in range(40))] + [(0, 0, 5000)]
    inner = [(p, rng.randrange(1200)) for p in range(4) for _ in range(60)] + [(None, 3), (0, None)]
    a, b = spark.createDataFrame(inner, "page_key long, at int"), spark.createDataFrame(outer, "page_key long, first int, last int")
    want = sorted((p, x, f, g) for p, x in inner if None not in (p, x) for q, f, g in outer if p == q and f <= x <= g)
    assert sorted(tuple(r) for r in T.enclosed(a, b).select("page_key", "at", "first", "last").collect()) == want
    assert T.enclosed(a, b.where("false")).count() == T.enclosed(a.where("false"), b).count() == 0


def test_selectors(spark):
    html = '<a class="x fileThumb y" href="/a/images/b">1</a><a id=highres>2</a><b class=fileThumbs>3</b><p class="a-VIDEO-b">4</p>'
    e = extract.elements(spark.createDataFrame([(1, "https://a.b/", html), (2, None, None)], PAGES))
    got = sorted((r["name"], r["text"]) for r in T.hits(e, originals.SELECTORS).where("name <> 'link'").collect())
    assert got == [("full link", "2"), ("images link", "1"), ("moving", "4"), ("thumb link", "1")]


#: page, markup with one image marked here, the image's address, and what is found (address, kind, media key), or None.
LONG = "0123456789abcdef0123456789abcdef"
CASES = [
    # a post's own attribute, of the element or around it; larger renditions, and JSON of uris
    ("https://danbooru.donmai.us/posts/5", '<section data-file-url="https://cdn.donmai.us/o/a.png" data-id="5" data-width="300" data-height="200"><p><img here></p></section>', "https://cdn.donmai.us/s/a.jpg", ("https://cdn.donmai.us/o/a.png", "image", "booru danbooru.donmai.us 5")),
    ("https://danbooru.donmai.us/posts/6", '<article data-large-file-url="https://cdn.donmai.us/l/b.webm"><img here data-id="6"></article>', "https://cdn.donmai.us/s/b.jpg", ("https://cdn.donmai.us/l/b.webm", "video", "booru danbooru.donmai.us 6")),
    ("https://danbooru.donmai.us/posts/7", '<article data-file-url="https://cdn.evil.example/o/a.png"><img here></article>', "https://cdn.donmai.us/s/a.jpg", None),
    ("https://danbooru.donmai.us/posts/7", '<article data-file-url="http://cdn.donmai.us/o/a.png"><img here></article>', "https://cdn.donmai.us/s/a.jpg", None),
    ("https://danbooru.donmai.us/posts/8", '<article data-file-url="https://cdn.donmai.us/o/outer.png"><div data-file-url="https://cdn.donmai.us/o/inner.gif"><img here></div></article>', "https://cdn.donmai.us/s/a.jpg", ("https://cdn.donmai.us/o/inner.gif", "gif", None)),
    ("https://danbooru.donmai.us/posts/9", '<article data-file-url=""><div data-uris=\'{"full":"https://x.donmai.us/f.png"}\'><img here></div></article>', "https://cdn.donmai.us/s/a.jpg", ("https://x.donmai.us/f.png", "image", None)),
    ("https://derpibooru.org/images/1", '<div data-uris="{&quot;full&quot;:&quot;https://derpicdn.net/img/view/1.png&quot;,&quot;small&quot;:&quot;x&quot;}"><img here></div>', "https://derpicdn.net/img/1/small.png", ("https://derpicdn.net/img/view/1.png", "image", None)),
    ("https://derpibooru.org/images/2", "<div data-uris='not json'><img here></div>", "https://derpicdn.net/img/2/small.png", None),
    ("https://derpibooru.org/images/3", "<div data-uris='{\"full\":7}'><img here></div>", "https://derpicdn.net/img/3/small.png", None),
    ("https://yande.re/post/show/1", '<img here id="image"><a id="highres" href="https://files.yande.re/image/x.png">o</a>', "https://files.yande.re/sample/x.jpg", ("https://files.yande.re/image/x.png", "image", None)),
    ("https://yande.re/post/show/2", '<img here><a id="highres" href="https://files.yande.re/image/x.png">o</a>', "https://files.yande.re/sample/x.jpg", None),
    ("https://gelbooru.com/index.php?id=1", '<img here id="image"><a href="https://img3.gelbooru.com/images/aa/bb/x.png">Original</a>', "https://img3.gelbooru.com/samples/x.jpg", ("https://img3.gelbooru.com/images/aa/bb/x.png", "image", None)),
    ("https://other.example/posts/5", '<section data-file-url="https://cdn.donmai.us/o/a.png"><img here></section>', "https://cdn.donmai.us/s/a.jpg", None),
    # JSON-LD before the link, and only in the page's frame
    ("https://www.zerochan.net/1", '<script type="application/ld+json">{"@type":"ImageObject","contentUrl":"https://static.zerochan.net/full/1.png"}</script><div id="large"><a class="preview" href="https://static.zerochan.net/p.jpg"><img here></a></div>', "https://s1.zerochan.net/1.240.jpg", ("https://static.zerochan.net/full/1.png", "image", None)),
    ("https://www.zerochan.net/2", '<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"@type":"WebSite","contentUrl":"https://static.zerochan.net/no.png"},{"contentUrl":"https://static.zerochan.net/g.png"}]}</script><div id="large"><img here></div>', "https://s1.zerochan.net/2.jpg", ("https://static.zerochan.net/g.png", "image", None)),
    ("https://www.zerochan.net/3", '<div id="large"><a class="preview" href="https://static.zerochan.net/f.jpg"><img here></a></div>', "https://s1.zerochan.net/3.jpg", ("https://static.zerochan.net/f.jpg", "image", None)),
    ("https://www.zerochan.net/4", '<div id="large"></div><a class="preview" href="https://static.zerochan.net/f.jpg"><img here></a>', "https://s1.zerochan.net/4.jpg", None),
    # boards: around, in the same file, in the post's text
    ("https://boards.4chan.org/g/thread/1", '<div class="file"><a class="fileThumb" href="//i.4cdn.org/g/1700.webm"><img here></a></div>', "https://i.4cdn.org/g/1700s.jpg", ("https://i.4cdn.org/g/1700.webm", "video", "4chan 1700")),
    ("https://boards.4chan.org/g/thread/2", '<div class="file"><a class="fileThumb" href="//i.4cdn.org/g/18.png">t</a><img here></div>', "https://i.4cdn.org/g/18s.jpg", ("https://i.4cdn.org/g/18.png", "image", "4chan 18")),
    ("https://boards.4channel.org/g/thread/3", '<div class="post"><div class="fileText">File: <a href="//i.4cdn.org/g/19.gif">x</a></div><p><a href="/no">n</a><img here></p></div>', "https://i.4cdn.org/g/19s.jpg", ("https://i.4cdn.org/g/19.gif", "gif", "4chan 19")),
    ("https://boards.4chan.org/g/thread/4", '<div class="post"><a href="//i.4cdn.org/g/20.png">x</a><img here></div>', "https://i.4cdn.org/g/20s.jpg", None),
    ("https://desuarchive.org/a/thread/1", '<article class="post"><a class="thread_image_link" href="https://desu-usergeneratedcontent.xyz/a/image/77.png"><img here></a></article>', "https://desu-usergeneratedcontent.xyz/a/thumb/77s.jpg", ("https://desu-usergeneratedcontent.xyz/a/image/77.png", "image", "foolfuuka desuarchive.org 77")),
    ("https://archive.4plebs.org/x/thread/1", '<div class="post"><a class="thread_image_link" href="//i.4pcdn.org/x/88.jpg">t</a><p><img here></p></div>', "https://i.4pcdn.org/x/88s.jpg", ("https://i.4pcdn.org/x/88.jpg", "image", "foolfuuka archive.4plebs.org 88")),
    ("https://archive.4plebs.org/x/thread/2", '<div class="post"><a class="thread_image_link" href="https://desu-usergeneratedcontent.xyz/88.jpg"><img here></a></div>', "https://i.4pcdn.org/x/88s.jpg", None),
    ("https://pikabu.ru/story/1", '<div class="story-image"><a class="story-image__link" href="https://cs1.pikabu.ru/post_img/big/1.png"><img here></a></div>', "https://cs1.pikabu.ru/post_img/1.jpg", ("https://cs1.pikabu.ru/post_img/big/1.png", "image", None)),
    ("https://pikabu.ru/story/2", '<div class="story-image"><img here><a class="story-image__link" href="https://cs1.pikabu.ru/post_img/big/2.gif">+</a></div>', "https://cs1.pikabu.ru/post_img/2.jpg", ("https://cs1.pikabu.ru/post_img/big/2.gif", "gif", None)),
    # one link for the whole page; the largest of many
    ("https://postimg.cc/abc", '<img here><a id="download" href="https://i.postimg.cc/9C/image.jpg?dl=1">d</a>', "https://i.postimg.cc/xx/image.jpg", ("https://i.postimg.cc/9C/image.jpg", "image", None)),
    ("https://postimg.cc/same", '<img here><a id="download" href="https://i.postimg.cc/9C/image.jpg?dl=1">d</a>', "https://i.postimg.cc/9C/image.jpg", None),
    ("https://4kwallpapers.com/a/b-1.html", '<img here><a href="/images/wallpapers/b-1920x1080-1.jpg">s</a><a href="/images/wallpapers/b-3840x2160-1.jpg">l</a><a href="/images/wallpapers/b-2160x3840-1.jpg">p</a>', "https://4kwallpapers.com/images/walls/thumbs/1.jpg", ("https://4kwallpapers.com/images/wallpapers/b-3840x2160-1.jpg", "image", None)),
    ("https://wallpaperswide.com/x.html", '<img here><div class="wallpaper-resolutions"><p><a href="/download/x-1280x720.jpg">s</a><a href="/download/x-2560x1440.jpg">l</a></p></div><a href="/download/y-7680x4320.jpg">other</a>', "https://wallpaperswide.com/t1/x.jpg", ("https://wallpaperswide.com/download/x-2560x1440.jpg", "image", None)),
    # by the image's own address
    ("https://wallpaperscraft.com/wallpaper/a_1", '<img here><a href="/download/a_1/1920x1080">s</a><a href="/download/a_1/3840x2160?x">l</a><a href="/download/b_2/9000x9000">o</a>', "https://images.wallpaperscraft.com/image/single/a_1_1280x720.jpg", ("https://images.wallpaperscraft.com/image/single/a_1_3840x2160.jpg", "image", None)),
    ("https://wallpaperscraft.com/wallpaper/a_1", '<img here><a href="/download/a_1/640x480">s</a>', "https://images.wallpaperscraft.com/image/single/a_1_1280x720.jpg", None),
    ("https://anime-pictures.net/posts/1", f'<meta property="og:image" content="https://opreviews.anime-pictures.net/012/{LONG}_bp.avif"><img here><a class="icon-download" href="https://api.anime-pictures.net/pictures/download_image/1-a.png">d</a>', f"https://opreviews.anime-pictures.net/012/{LONG}_cp.avif", ("https://api.anime-pictures.net/pictures/download_image/1-a.png", "image", f"animepictures {LONG}")),
    ("https://anime-pictures.net/posts/2", f'<meta property="og:image" content="https://opreviews.anime-pictures.net/fff/{"f" * 32}_bp.avif"><img here><a class="icon-download" href="https://api.anime-pictures.net/pictures/download_image/1-a.png">d</a>', f"https://opreviews.anime-pictures.net/012/{LONG}_cp.avif", None),
    # a cell that shows a clip, its neighbour that does not
    ("https://www.artstation.com/u", '<div><a href="/artwork/aB1"><img here></a><video></video></div>', "https://cdna.artstation.com/p/assets/images/images/1/smaller_square/a.jpg", ("https://cdna.artstation.com/p/assets/images/images/1/smaller_square/a.jpg", "video", None)),
    ("https://www.artstation.com/u", '<div data-test-id="cell"><a href="/artwork/aB2"><img here></a></div><div data-test-id="cell"><i class="is-Video"></i></div>', "https://cdna.artstation.com/p/assets/images/images/2/smaller_square/a.jpg", ("https://cdna.artstation.com/p/assets/images/images/2/large/a.jpg", "image", None)),
]


@pytest.fixture(scope="module")
def found(spark):
    pages = [(i, page, html.replace("<img here", f'<img src="{src}"')) for i, (page, html, src, _) in enumerate(CASES)]
    e = extract.elements(spark.createDataFrame([*pages, (900, None, None), (901, "https://yande.re/post/show/9", "")], PAGES)).cache()
    images = extract.image_urls(e).select(F.col("page_id").alias("page_key"), F.col("url").alias("page_url"), F.col("elem_ordinal").alias("at"), "src", F.lit(1).alias("name"))
    return {r["page_key"]: r for r in originals.element_originals(images.unionByName(images), e).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_originals_by_site(found, case):
    r, want = found.get(case), CASES[case][3]
    assert (r and (r["original"], r["kind"], r["media_key"])) == want


def test_originals_facts(found):
    assert (found[0]["width"], found[0]["height"], found[0]["ext"], found[0]["thumbnail"]) == (300, 200, "png", CASES[0][2])
    clip, still = found[len(CASES) - 2], found[len(CASES) - 1]
    assert (clip["hint"], clip["pending"], clip["ext"]) == ("vid aB1", True, "mp4")
    assert (still["hint"], still["pending"]) == ("img https://cdna.artstation.com/p/assets/images/images/2/large/a.jpg", None)
