"""Page readers by rule."""

from lumenweft.operators.readers import page_media


def test_readers(spark):
    pages = [
        (1, "https://www.erome.com/a/AbC", '<div class="media-group"><img data-src="https://s1.erome.com/1.jpg"></div><div class="media-group"><source src="https://v1.erome.com/2.mp4"><img data-src="https://s1.erome.com/t.jpg"></div><div class="media-group"><img data-src="https://evil.com/3.jpg"></div>'),
        (2, "https://imgchest.com/p/xy", "https://cdn.imgchest.com/files/aa.png https://cdn.imgchest.com/files/aa.png https://cdn.imgchest.com/files/bb.gif https://cdn.imgchest.com/files/cc.php"),
        (3, "https://kemono.su/fanbox/user/1/post/77", '<a href="https://n1.kemono.su/data/a/b.bin?f=x%20y.png">  <img src="https://img.kemono.su/thumbnail/data/z.jpg">'),
        (4, "https://lensdump.com/i/q1", '<meta content="https://i.l3n.co/q.webp" property="og:image">'),
        (5, "https://www.xvideos.com/video.abc/x", "html5player.setVideoUrlLow('https://cdn.xvideos-cdn.com/l.mp4'); html5player.setVideoUrlHigh('http://evil/h.mp4')"),
        (6, "https://snootbooru.com/post/9", '<img src="/data/posts/9_a.jpg"><img src="/data/posts/8_b.jpg">'),
        (7, "https://unknown.example/", "x"), (8, "https://imgchest.com/p/none", None), (9, None, None),
    ]
    got = [tuple(r)[:1] + (r["kind"], r["url"], r["media_key"]) for r in page_media(spark.createDataFrame(pages, "page_id int, url string, html string")).orderBy("page_id", "idx").collect()]
    assert got == [
        (1, "image", "https://s1.erome.com/1.jpg", "erome AbC 0"), (1, "video", "https://v1.erome.com/2.mp4", "erome AbC 1"),
        (2, "image", "https://cdn.imgchest.com/files/aa.png", "imgchest xy 0"), (2, "gif", "https://cdn.imgchest.com/files/bb.gif", "imgchest xy 1"),
        (3, "image", "https://n1.kemono.su/data/a/b.bin?f=x%20y.png", "kemono 77 b.bin"), (4, "image", "https://i.l3n.co/q.webp", "lensdump q1"),
        (5, "video", "https://cdn.xvideos-cdn.com/l.mp4", "xvideos abc"), (6, "image", "https://snootbooru.com/data/posts/9_a.jpg", "szuru snootbooru.com 9"),
    ]
