"""Pages whose sites offer an item several times, and hosts of single images."""

import base64
import json

from lumenweft.operators.offers import offered_media, site_media

PAGES = "page_id int, url string, html string"


def found(spark, pages):
    rows = offered_media(spark.createDataFrame(pages, PAGES)).orderBy("page_id", "idx").collect()
    return [(r["page_id"], r["idx"], r["kind"], r["url"], r["ext"], r["media_key"], r["poster"]) for r in rows]


def test_patreon(spark):
    size = lambda **k: base64.b64encode(json.dumps(k).encode()).decode()
    file = lambda post, h, t, f: f"https://c1.patreonusercontent.com/4/patreon-media/p/post/{post}/{h}/{t}/{f}?token=s{t}"
    small, wide, whole = size(w=620), size(w=1920, h=10), size(a=1, p=1)
    html = " ".join(f'"{x}"' for x in (
        file(77, "aa", small, "1.png"), file(77, "bb", wide, "2.jpg"), file(77, "aa", whole.replace("=", "%3D"), "1.png"), file(77, "aa", wide, "1.png"), file(77, "bb", "a", "2.jpg"), file(77, "cc", small, "x.gif"), file(77, "dd", whole, "y.mp4"), file(78, "ee", whole, "z.png"),
        file(77, "ff", "!!bad", "q.jpg"),
    ))
    assert found(spark, [(1, "https://www.patreon.com/posts/some-title-77?x=1", html), (2, "https://www.patreon.com/c/77", html), (3, "https://patreon.com/posts/77", None)]) == [
        (1, 0, "image", file(77, "aa", whole.replace("=", "%3D"), "1.png"), "png", "patreon 77 aa/1.png", None), (1, 1, "image", file(77, "bb", wide, "2.jpg"), "jpg", "patreon 77 bb/2.jpg", None),
        (1, 2, "gif", file(77, "cc", small, "x.gif"), "gif", "patreon 77 cc/x.gif", None), (1, 3, "image", file(77, "ff", "!!bad", "q.jpg"), "jpg", "patreon 77 ff/q.jpg", None),
    ]


def test_fapello(spark):
    block = '<div class="a uk-align-center b">{}</div>'
    got = found(spark, [
        (1, "https://fapello.com/a-b.c/7", block.format('<img src="https://cdn.fapello.com/x.md.jpg">')),
        (2, "https://fapello.su/m/9/", block.format('<video type="video" poster="https://cdn.fapello.com/p.jpg"><source src="https://cdn.fapello.com/c.mp4"></video>')),
        (3, "https://fapello.com/videos/2/", block.format('<img src="https://cdn.fapello.com/x.jpg">')), (4, "https://fapello.com/m/1/", '<img src="https://cdn.fapello.com/x.jpg">'), (5, "https://fapello.com/m/", block.format('<img src="https://c/x.jpg">')),
    ])
    assert got == [(1, 0, "image", "https://cdn.fapello.com/x.jpg", "jpg", "fapello a-b.c 7", None), (2, 0, "video", "https://cdn.fapello.com/c.mp4", "mp4", "fapello m 9", "https://cdn.fapello.com/p.jpg")]


def test_imgur(spark):
    post = {"id": "A", "media": [{"id": "aa", "url": "https://i.imgur.com/aa.jpeg"}, {"id": "b", "url": "https://evil.example/b.jpg"}, {"url": "https://i.imgur.com/c.mp4"}, {"id": "d", "url": "https://i.imgur.com/aa.jpeg"}, {"id": "e", "url": "https://i.imgur.com/e.gif"}]}
    text = f"<script>window.postDataJSON={json.dumps(json.dumps(post))};</script>"
    plain = '<script>window.postDataJSON = {"media":[{"id":"z","url":"https://i.imgur.com/z.png"}]}</script>'
    long = {"media": [{"id": str(i), "url": f"https://i.imgur.com/{i}.png"} for i in range(3000)]}
    got = found(spark, [(1, "https://imgur.com/a/A", text), (2, "https://imgur.io/z", plain), (3, "https://imgur.com/a/A", "<p>x</p>"), (4, "https://imgur.com/a/A", "window.postDataJSON=\"{bad\""), (5, "https://imgur.com.evil.example/a", text), (6, "https://imgur.com/l", f"window.postDataJSON={json.dumps(json.dumps(long))}")])
    assert got[:4] == [
        (1, 0, "image", "https://i.imgur.com/aa.jpeg", "jpeg", "imgur aa", None), (1, 1, "video", "https://i.imgur.com/c.mp4", "mp4", "imgur 2", None), (1, 2, "gif", "https://i.imgur.com/e.gif", "gif", "imgur e", None),
        (2, 0, "image", "https://i.imgur.com/z.png", "png", "imgur z", None),
    ]
    assert [r[3] for r in got[4:]] == [m["url"] for m in long["media"]] and {r[0] for r in got[4:]} == {6}


def test_players(spark):
    page = lambda head, value: f"<p>{{}}</p><script>{head} {json.dumps(value)};var x = {{}};</script>"
    mp4 = {"240p": "https://a.xhcdn.com/240.mp4", "1080p": "https://a.xhcdn.com/1080.mp4", "2160p": "https://evil.example/x.mp4"}
    h264 = [{"url": "https://a.xhcdn.com/720.mp4", "quality": "720p"}, {"url": "https://a.xhcdn.com/1440.mp4", "quality": "1440p"}]
    streams = [{"format": "hls", "videoUrl": "https://h.phncdn.com/240/master.m3u8?t=1", "quality": "240"}, {"format": "HLS", "videoUrl": "https://h.phncdn.com/master.m3u8", "quality": ["240", "720"], "remote": False}, {"format": "mp4", "videoUrl": "https://www.pornhub.com/get", "quality": ["720"], "remote": True}]
    videos = [{"name": "mobile", "url": "https://v.okcdn.ru/?id=m"}, {"name": "ultra", "url": "https://evil.example/u"}, {"name": "FULL", "url": "https://v.mycdn.me/?id=f"}, {"name": "sd", "url": "https://v.okcdn.ru/?id=s"}]
    options = lambda meta: json.dumps({"flashvars": {"metadata": meta}}).replace("&", "&amp;").replace('"', "&quot;")
    ok = lambda *metas: "".join(f'<div data-options="{options(m)}"></div>' for m in metas)
    got = found(spark, [
        (1, "https://xhamster.com/videos/a-title-98x", page("window.initials =", {"videoModel": {"id": 5, "sources": {"mp4": mp4}}})), (2, "https://xhamster2.desi/videos/b-7", page("window.initials=", {"videoModel": {"sources": {"mp4": mp4, "standard": {"h264": h264}}}})),
        (3, "https://xhamster.com/videos/c-8", page("window.initials =", {"videoModel": {}})), (4, "https://cn.pornhub.com/view_video.php?viewkey=ph5", page("var flashvars_48 =", {"image_url": "https://ci.phncdn.com/p.jpg", "mediaDefinitions": streams})),
        (5, "https://www.pornhub.com/embed/ab1", page("flashvars_1 =", {"image_url": "https://evil.example/p.jpg", "mediaDefinitions": streams[:1]})), (6, "https://www.pornhub.com/embed/ab2", page("flashvars_1 =", {"mediaDefinitions": streams[2:]})), (7, "https://www.pornhub.com/model/x", page("flashvars_1 =", {"mediaDefinitions": streams})),
        (8, "https://m.ok.ru/video/219?st=x", ok({"ad": 1}, json.dumps({"videos": videos}), {"videos": [{"name": "ultra", "url": "https://v.okcdn.ru/?second"}]})), (9, "https://ok.ru/videoembed/3", ok({"videos": videos[3:]})), (10, "https://ok.ru/video/4", ok({"hls": "x"}) + "<i data-options='{bad'>"), (11, "https://ok.ru/group/4", ok({"videos": videos})),
        (12, None, ok({"videos": videos})), (13, "https://ok.ru/video/5", ""),
    ])
    assert got == [
        (1, 0, "video", "https://a.xhcdn.com/1080.mp4", "mp4", "xhamster 98x", None), (2, 0, "video", "https://a.xhcdn.com/1440.mp4", "mp4", "xhamster 7", None),
        (4, 0, "video", "https://h.phncdn.com/master.m3u8", "m3u8", "pornhub ph5", "https://ci.phncdn.com/p.jpg"), (5, 0, "video", "https://h.phncdn.com/240/master.m3u8?t=1", "m3u8", "pornhub ab1", None),
        (8, 0, "video", "https://v.mycdn.me/?id=f", "mp4", "okru 219", None), (9, 0, "video", "https://v.okcdn.ru/?id=s", "mp4", "okru 3", None),
    ]


def test_single_image_hosts(spark):
    og = '<meta property="og:image" content="{}">'
    pages = [
        (1, "https://jpg5.su/img/My.Id", og.format("https://simp.example/a.jpg")), (2, "https://jpg5.su/img/x", og.format("https://simp.example/loading.svg")), (3, "https://jpg5.su/img/y", og.format("bm90IGEgdXJs")), (4, "https://imglike.com/i/z", '<meta content="https://c.example/v.mp4" property="og:image">'),
        (5, "https://imgpile.com/p/s_1", '<div class="post-media"><a href="https://cdn.example/1.png">x</a></div><i class="x post-media y"><a class="q" href="https://cdn.example/2.mp4"></i><b class="post-media"><a href="https://cdn.example/1.png"></b><b class="post-media"><a href="https://cdn.example/page"></b>'),
        (6, "https://imgdrive.net/img-ab1.html", og.format("https://imgdrive.net/images/small/a.jpg")), (7, "https://imgspice.com/x/y.html", "<img id='other' src='/no.jpg'><img class=q id='imgpreview' src='/i/7.jpg'>"), (8, "https://imgspice.com/x.html", '<img id="imgpreview" src="https://evil.example/x.jpg">'),
        (9, "https://picstate.com/view/full/9", '<div id="image_container"><a><img alt="q" src="https://picstate.com/files/9.png"></a></div>'), (10, "https://www.imagebam.com/view/ME1", '<img src="https://www.imagebam.com/logo.png"><img alt=x src="https://images4.imagebam.com/a.jpg">'),
        (11, "https://www.imagevenue.com/ME1ABCDE", '<img src="https://img1.imagevenue.com/loader.svg"><img src="https://img1.imagevenue.com/aa/x.jpg">'), (12, "https://pixhost.to/show/1/n.jpg", '<img class="a image-img" src="https://img1.pixhost.to/y.gif">'),
        (13, "https://imagetwist.com/abcdefgh1", '<img src="https://img1.imagetwist.com/imgs/logo.png"><img src="https://img2.imagetwist.com/i/1.jpg">'), (14, "https://imgpv.com/a.html", '<img src="http://imgpv.com/1.jpg" id="img-preview">'), (15, "https://imgpv.com/a.html", '<img src="//s.imgpv.com/1.jpg" id="img-preview">'),
        (16, "https://example.com/img-x.html", og.format("https://example.com/x.jpg")),
    ]
    rows = site_media(spark.createDataFrame(pages, PAGES)).orderBy("page_id", "idx").collect()
    assert [(r["page_id"], r["kind"], r["url"], r["media_key"]) for r in rows] == [
        (1, "image", "https://simp.example/a.jpg", "chevereto jpg5.su My.Id"), (4, "video", "https://c.example/v.mp4", "chevereto imglike.com z"),
        (5, "image", "https://cdn.example/1.png", "imgpile s_1 0"), (5, "video", "https://cdn.example/2.mp4", "imgpile s_1 1"),
        (6, "image", "https://imgdrive.net/images/big/a.jpg", "imghost imgdrive.net/img-ab1.html"), (7, "image", "https://imgspice.com/i/7.jpg", "imghost imgspice.com/x/y.html"),
        (9, "image", "https://picstate.com/files/9.png", "imghost picstate.com/view/full/9"), (10, "image", "https://images4.imagebam.com/a.jpg", "imghost www.imagebam.com/view/ME1"),
        (11, "image", "https://img1.imagevenue.com/aa/x.jpg", "imghost www.imagevenue.com/ME1ABCDE"), (12, "gif", "https://img1.pixhost.to/y.gif", "imghost pixhost.to/show/1/n.jpg"),
        (13, "image", "https://img2.imagetwist.com/i/1.jpg", "imghost imagetwist.com/abcdefgh1"), (15, "image", "https://s.imgpv.com/1.jpg", "imghost imgpv.com/a.html"),
    ]


def test_empty(spark):
    assert found(spark, []) == []
