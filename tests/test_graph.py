"""Captured JSON: walks over objects and arrays with what they inherit, shapes by site, and the join by a page's item."""

import json

import pytest
from pyspark.sql import functions as F

from lumenweft.operators import graph as G

BODY = "payload_id long, platform string, request_url string, body string"
CDN = "https://scontent.xx.fbcdn.net/"
CHAPTER = "01234567-89ab-cdef-0123-456789abcdef"


def image(name, w=900, h=900, **more):
    return {"uri": f"{CDN}{name}", "width": w, "height": h, **more}


def pin(name, **more):
    return {"url": f"https://i.pinimg.com/{name}", **more}


#: platform, body, and what is found: (owner, kind, name of the file), in order.
CASES = [
    # the nearest id above owns; none, no owner; ids that are no digits do not count
    ("facebook", {"id": "11", "a": {"b": [image("1.jpg")]}, "c": {"id": "12", "d": image("2.png", 800, 800)}}, [("11", "image", "1.jpg"), ("12", "image", "2.png")]),
    ("facebook", {"a": image("1.jpg")}, []),
    ("facebook", {"id": "1", "x": {"id": "node:5", "y": image("1.jpg")}}, [("1", "image", "1.jpg")]),
    # renditions under sibling keys fold to the largest; elements of an array do not
    ("facebook", {"id": "1", "image": image("s.jpg", 200, 200), "viewer_image": image("l.jpg", 2000, 1500), "photo_image": image("m.jpg", 400, 400)}, [("1", "image", "l.jpg")]),
    ("facebook", {"id": "1", "edges": [{"n": image("a.jpg")}, {"n": image("b.jpg", 300, 300), "o": image("c.jpg", 600, 600)}]}, [("1", "image", "a.jpg"), ("1", "image", "c.jpg")]),
    # small ones, sizes that are no numbers, other hosts, plain http, and keys of what is no media
    ("facebook", {"id": "1", "a": image("a.jpg", 127, 900), "b": image("b.jpg", "900", 900), "c": {"uri": "https://evil.example/fbcdn.net/c.jpg", "width": 900, "height": 900}, "d": {"uri": "http://x.fbcdn.net/d.jpg", "width": 900, "height": 900}, "preview_image": image("e.jpg"), "thumbnailList": [image("f.jpg")]}, []),
    # the first address key of a video counts; its poster stays with it
    ("facebook", {"id": "5", "playable_url": f"{CDN}sd.mp4", "playable_url_quality_hd": f"{CDN}hd.mp4?x=1", "preferred_thumbnail": {"image": {"uri": f"{CDN}c.jpg"}}}, [("5", "video", "hd.mp4?x=1")]),
    ("facebook", {"id": "5", "playable_url_quality_hd": "https://evil.example/a.mp4", "progressive_url": f"{CDN}p"}, [("5", "video", "p")]),
    # images come first, an address counts once
    ("facebook", {"id": "5", "a": {"playable_url": f"{CDN}v.mp4"}, "b": image("i.jpg"), "c": {"x": [image("i.jpg")]}}, [("5", "image", "i.jpg"), ("5", "video", "v.mp4")]),
    ("pinterest", {"id": "123456", "images": {"236x": pin("s.jpg", width=236), "736x": pin("l.jpg", width=736)}}, [("123456", "image", "l.jpg")]),
    ("pinterest", {"id": "123456", "images": {"736x": pin("l.jpg", width=736), "orig": pin("o.png", width=1)}}, [("123456", "image", "o.png")]),
    ("pinterest", {"id": "12345", "images": {"orig": pin("o.png")}}, []),
    ("pinterest", [{"type": "board", "id": "123456", "images": {"orig": pin("b.png")}}, {"type": "user", "id": "123457", "images": {"orig": pin("u.png")}}, {"type": "story", "id": "123458", "images": {"orig": pin("s.png")}}], [("123458", "image", "s.png")]),
    ("pinterest", {"id": "123456", "images": {"orig": pin("cover.jpg")}, "carousel_data": {"carousel_slots": [{"images": {"orig": pin("1.jpg")}}, {"id": "7", "images": {"orig": pin("2.jpg")}}]}}, [("123456", "image", "1.jpg"), ("123456", "image", "2.jpg")]),
    ("pinterest", {"id": "123456", "videos": {"video_list": {"V_HLSV4": {"url": "https://v1.pinimg.com/a.m3u8"}, "V_HLSV3_MOBILE": {"url": "https://v1.pinimg.com/b.m3u8"}}}, "images": {"orig": pin("p.jpg")}}, [("123456", "video", "a.m3u8")]),
    ("pinterest", {"id": "123456", "protected_delivery": True, "videos": {"video_list": {"V_720P": {"url": "https://v1.pinimg.com/a.mp4"}}}, "images": {"orig": pin("p.jpg")}}, [("123456", "image", "p.jpg")]),
    # a video that was met before leaves the pin's image
    ("pinterest", [{"id": "123456", "videos": {"video_list": {"V_720P": {"url": "https://v1.pinimg.com/a.mp4"}}}}, {"id": "123457", "videos": {"video_list": {"V_720P": {"url": "https://v1.pinimg.com/a.mp4"}}}, "images": {"orig": pin("p.jpg")}}], [("123456", "video", "a.mp4"), ("123457", "image", "p.jpg")]),
    ("mangadex", {"baseUrl": "https://x.mangadex.network//", "chapter": {"hash": "0" * 32, "data": ["1-a.png", "b/c.png", "2-b.JPG"], "dataSaver": ["s.jpg"]}}, [(CHAPTER, "image", "1-a.png"), (CHAPTER, "image", "2-b.JPG")]),
    ("mangadex", {"baseUrl": "https://uploads.mangadex.org", "chapter": {"hash": "0" * 32, "data": [], "dataSaver": ["s.jpg"]}}, [(CHAPTER, "image", "s.jpg")]),
    ("mangadex", {"baseUrl": "https://mangadex.network.evil.example", "chapter": {"hash": "0" * 32, "data": ["1.png"]}}, []),
    ("mangadex", {"baseUrl": "https://uploads.mangadex.org", "chapter": {"hash": "xyz", "data": ["1.png"]}}, []),
]
REQUEST = f"https://api.mangadex.org/at-home/server/{CHAPTER}?x=1"


@pytest.fixture(scope="module")
def captured(spark):
    rows = [(i, platform, REQUEST, json.dumps(body)) for i, (platform, body, _) in enumerate(CASES)]
    lines = "for (;;);" + json.dumps({"id": "71", "a": image("x.jpg")}) + "\n" + json.dumps({"id": "72", "a": image("y.jpg")}) + "\n{broken fbcdn"
    rows += [(100, "facebook", None, lines), (101, "facebook", None, None), (102, "facebook", None, ""), (103, "other", None, json.dumps(image("z.jpg"))), (104, None, None, "{}")]
    deep = {"id": "81", "leaf": image("deep.jpg")}
    for _ in range(40):
        deep = {"k": [deep]}
    return G.captured_media(spark.createDataFrame([*rows, (105, "facebook", None, json.dumps(deep))], BODY)).cache()


@pytest.mark.parametrize("case", range(len(CASES)))
def test_shapes(captured, case):
    got = [(r["owner_id"], r["kind"], r["url"].rsplit("/", 1)[1]) for r in captured.where(F.col("payload_id") == case).orderBy("ord").collect()]
    assert got == CASES[case][2]


def test_lines_prefixes_and_broken_bodies(captured):
    assert sorted((r["payload_id"], r["owner_id"]) for r in captured.where("payload_id >= 100").collect()) == [(100, "71"), (100, "72"), (105, "81")]


def test_items_over_bodies(spark):
    rows = [
        (1, "facebook", "9", "image", "small", "jpg", 100, 100, None, None, "1"), (2, "facebook", "9", "image", "large", "jpg", 200, 100, None, None, "1"), (3, "facebook", "9", "image", "late", "jpg", 100, 200, None, None, "1"),
        (1, "facebook", "8", "video", "v", "mp4", None, None, "cover", None, "1"), (2, "facebook", "8", "image", "cover", "jpg", 9, 9, None, None, "1"), (3, "facebook", "8", "image", "other", "jpg", 1, 1, None, None, "1"),
        (1, "facebook", "7", "video", "p", "mp4", None, None, None, True, "1"), (2, "facebook", "7", "video", "r", "mp4", None, None, None, None, "1"), (1, "facebook", "6", "video", "p", "mp4", None, None, None, True, "1"),
        (2, "mangadex", "c", "image", "p2", "png", None, None, None, None, "000001"), (2, "mangadex", "c", "image", "p1", "png", None, None, None, None, "000000"), (3, "mangadex", "c", "image", "p1", "png", None, None, None, None, "000000"),
    ]
    df = spark.createDataFrame(rows, "payload_id long, platform string, owner_id string, kind string, url string, ext string, width int, height int, poster string, pending boolean, ord string")
    got = {}
    for r in G.by_item(df).orderBy("idx").collect():
        got.setdefault(r["owner_id"], []).append((r["src"], r["media_key"]))
    assert got == {"9": [("late", "fb:9")], "8": [("v", "fb:8#0"), ("other", "fb:8#1")], "7": [("r", "fb:7")], "6": [("p", "fb:6")], "c": [("p1", None), ("p2", None)]}
    assert G.by_item(df.where("false")).count() == 0


def test_items_of_addresses(spark):
    urls = {
        "https://www.facebook.com/photo/?fbid=12&set=a": ("facebook", "12"), "https://m.facebook.com/x/videos/13/": ("facebook", "13"), "https://facebook.com/reel/14": ("facebook", "14"), "https://www.facebook.com/photos/15": ("facebook", "15"),
        "https://www.facebook.com/user": None, "https://evil.example/photo/?fbid=12": None, "https://notfacebook.com/?fbid=1": None, "https://www.pinterest.de/pin/a-b--77/?x": ("pinterest", "77"), "https://pinterest.com/pin/77": ("pinterest", "77"),
        "https://www.pinterest.com/pin/77x/": None, f"https://mangadex.org/chapter/{CHAPTER.upper()}/3": ("mangadex", CHAPTER), "https://mangadex.org/chapter/1": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r["u"]: r["o"] and tuple(r["o"]) for r in df.select("u", G.owner_of(F.col("u")).alias("o")).collect()} == urls
