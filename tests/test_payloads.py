"""Captured JSON to media facts."""

import json

from lumenweft.operators import payloads as J


def test_walk_inherits_and_prefers():
    body = {"items": [{"code": "C1", "carousel_media": [{"media_type": 1, "pk": 7, "image_versions2": {"candidates": [{"url": "https://a.cdninstagram.com/s.jpg", "width": 10}, {"url": "https://a.cdninstagram.com/l.webp", "width": 90, "height": 5}, {"url": "https://evil.com/x.jpg", "width": 999}]}}], "media_type": 8},
                      {"code": "C2", "media_type": 2, "id": "5_6", "video_versions": [], "image_versions2": {"candidates": [{"url": "https://x.fbcdn.net/c.jpg", "width": 3}]}}]}
    rows = J.walk("instagram", "for (;;);" + json.dumps(body))
    assert [r[1:6] for r in rows] == [("C1", "7", "image", "https://a.cdninstagram.com/l.webp", "webp"), ("C2", "5_6", "video", "https://x.fbcdn.net/c.jpg", "mp4")]
    assert rows[1][-1] is True
    assert J.walk("instagram", None) == J.walk("instagram", "media_type no json") == []


def test_tables(spark):
    x = {"a": {"id_str": "9", "video_info": {"variants": [{"content_type": "application/x-mpegURL", "url": "https://video.twimg.com/a.m3u8"}, {"content_type": "video/mp4", "bitrate": 5, "url": "https://video.twimg.com/l.mp4"}, {"content_type": "video/mp4", "bitrate": 9, "url": "https://video.twimg.com/h.mp4"}]}}}
    tt = {"__DEFAULT_SCOPE__": {"webapp.video-detail": {"itemInfo": {"itemStruct": {"id": "3", "video": {"playAddr": "https://v.tiktok.com/d", "bitrateInfo": [{"Bitrate": 1, "PlayAddr": {"UrlList": ["https://v.tiktok.com/1"]}}, {"Bitrate": 2, "PlayAddr": {"UrlList": ["https://v.tiktok.com/2"]}}]}}}}}}
    shop = {"media": [{"id": 1, "media_type": "image", "src": "https://cdn.shopify.com/a.jpg"}, {"id": 2, "media_type": "video", "sources": [{"url": "https://cdn.shopify.com/l.mp4", "format": "mp4", "height": 360}, {"url": "https://cdn.shopify.com/h.mp4", "format": "mp4", "height": 720}]}, {"media_type": "model"}]}
    tenor = {"gifs": {"byId": {"12": {"media_formats": {"mp4": {"url": "https://media.tenor.com/a.mp4"}}}}}}
    coub = {"permalink": "ab1", "picture": "https://x.coub.com/p.jpg", "file_versions": {"share": {"default": "https://x.coub.com/v.mp4"}}}
    rows = [("x", "h", json.dumps(x)), ("tiktok", "t", json.dumps(tt)), ("shopify", "s", json.dumps(shop)), ("tenor", "12", json.dumps(tenor)), ("coub", "c", json.dumps(coub)), ("x", "n", None), ("tiktok", "b", "{"), ("shopify", "b", "[]"), ("coub", "b", "zz")]
    p = spark.createDataFrame(rows, "platform string, hint_id string, body string")
    assert [(r["owner_id"], r["url"]) for r in J.sniffed(p).collect()] == [("9", "https://video.twimg.com/h.mp4")]
    assert [(r["url"], r["media_key"]) for r in J.tiktok(p).collect()] == [("https://v.tiktok.com/2", "tiktok 3")]
    assert [(r["kind"], r["url"], r["media_key"]) for r in J.shopify(p).orderBy("ord").collect()] == [("image", "https://cdn.shopify.com/a.jpg", "shopify:1"), ("video", "https://cdn.shopify.com/h.mp4", "shopify:2")]
    got = {r["platform"]: (r["kind"], r["url"], r["media_key"]) for r in J.readers(p).collect()}
    assert got == {"tenor": ("video", "https://media.tenor.com/a.mp4", "tenor 12"), "coub": ("video", "https://x.coub.com/v.mp4", "coub ab1")}
    pages = spark.createDataFrame([(1, "5", 'a "https://downloads.fanbox.cc/images/post/5/k1.jpeg" https://downloads.fanbox.cc/images/post/6/z.png https://downloads.fanbox.cc/images/post/5/k1.jpeg'), (2, "x", None)], "page_id int, post_id string, html string")
    assert [(r["url"][-7:], r["media_key"]) for r in J.fanbox(pages).collect()] == [("k1.jpeg", "fanbox k1")]


def test_prefer_found(spark):
    facts = spark.createDataFrame([("o", "k", True), ("o", "k", None), ("o", "j", True), ("o", None, True)], "owner_id string, media_key string, pending boolean")
    assert J.prefer_found(facts).count() == 3
