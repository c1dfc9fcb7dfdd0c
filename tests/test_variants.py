"""Originals that are chosen among the renditions a page lists."""

from lumenweft.operators.variants import widest_listed

ROWS = "n int, page_url string, src string, listed array<string>, natural_width int, natural_height int"
UUID = "0123abcd-0123-0123-0123-0123456789ab"


def test_widest_listed(spark):
    m, a, t = "https://img.magnific.com/free/p.jpeg?t=s{0}&w={0}", "https://www.news.example/resizer/v2/ABC.png?auth=h&width={0}", "https://scontent.cdninstagram.com/v/1.jpg?w={0}"
    s, o = f"https://cdn.prod.www.spiegel.de/images/{UUID}_w{{0}}_r1.5_x.jpg", "https://img-s1.onedio.com/id-ab12/rev-0/w-{0}/h-{0}/f-jpg/s-ff0{0}.webp"
    shop, plain = "https://shop.example/", "https://news.example/a"
    rows = [
        (1, plain, m.format(740), [m.format(360) + " 360w", m.format(2000) + " 2000w", "https://evil.example/p.jpg 4000w", m.format(1060)], 100, 50),
        (2, plain, m.format(740), None, None, None), (3, plain, a.format(100), [a.format(900) + " 900w", "https://other.example/resizer/v2/Z.png?auth=h&width=5000 5000w", "https://www.news.example/plain.png 6000w"], 0, 10),
        (4, plain, "https://www.news.example/resizer/v2/ABC.png?width=1", [a.format(900) + " 900w"], None, None),
        (5, "https://www.threads.com/@x", t.format(1), [t.format(2) + " 640w", t.format(3) + " 2610w", t.format(4) + " 2610w"], 261, 100), (6, "https://www.threads.net/", t.format(1), ["https://evil.example/x.jpg 9000w", t.format(2) + " 640w"], None, None),
        (7, "https://www.instagram.com/", t.format(1), [t.format(2) + " 640w"], None, None), (8, plain, s.format(300), [s.format(1200) + " 1200w", s.format(600), s.format(5000).replace("0123abcd", "99999999")], None, None),
        (9, plain, s.format(900), [s.format(600) + " 600w"], None, None), (10, plain, o.format(300), [o.format(900) + " 1x", o.format(1200).replace("https", "http")], None, None), (11, shop, "https://x.example/a.jpg", [m.format(360)], None, None), (12, None, None, None, None, None),
    ]
    got = {r["n"]: (r["resolver"], r["original"], r["width"], r["height"], r["ext"], r["thumbnail"], r["media_key"]) for r in widest_listed(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {
        1: ("magnific", m.format(2000), 2000, 1000, "jpg", m.format(360), None), 2: ("magnific", m.format(740), 740, None, "jpg", None, None),
        3: ("arcxp", a.format(900), 900, None, "png", a.format(100), None), 4: (None, "https://www.news.example/resizer/v2/ABC.png?width=1", None, None, None, None, None),
        5: ("threads", t.format(3), 2610, 1000, "jpg", None, None), 6: ("threads", t.format(1), None, None, "jpg", None, None), 7: (None, t.format(1), None, None, None, None, None),
        8: ("spiegel", s.format(1200), 1200, 800, "jpg", s.format(300), f"spiegel {UUID}"), 9: ("spiegel", s.format(900), 900, 600, "jpg", None, f"spiegel {UUID}"),
        10: ("onedio", o.format(900), 900, 900, "webp", o.format(300), "onedio ab12"), 11: (None, "https://x.example/a.jpg", None, None, None, None, None), 12: (None, None, None, None, None, None, None),
    }
    assert widest_listed(spark.createDataFrame([], ROWS)).count() == 0
