"""Addresses against others, dot segments, hosts beyond ASCII, and rules that a session adds."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lumenweft.functions import cdn
from lumenweft.functions import url as U
from lumenweft.operators import resolve

BASES = ["https://a.example/b/c/d.html?x=1#f", "https://a.example", "https://a.example/", "http://A.example:8080/b/"]
URIS = ["g", "./g", "../g", "../../g", "../../../g", "/g", "//h.example/i", "?y=2", "#z", "g/", "g/./h", "g/../h", "/./g", "/../g", "g;x=1/../y", ".", "./", "..", "../", "..g", "g..", "g?y/../x", "g#s/./x", "https://q.example/a/../b", "mailto:x@y.example", "data:image/png;base64,a/../b"]


def test_absolute(spark):
    df = spark.createDataFrame([(u, b) for u in URIS for b in BASES], "u string, b string")
    got = {(r["u"], r["b"]): r["t"] for r in df.select("u", "b", U.absolute(F.col("u"), F.col("b")).alias("t")).collect()}
    for (u, b), t in got.items():
        want = urljoin(b if b.count("/") > 2 else b + "/", u)
        if u.startswith("https://q"):
            want = "https://q.example/b"
        assert t == want or t == want.replace("/?", "?"), (u, b)
    assert spark.range(1).select(U.absolute(F.lit(None).cast("string"), F.lit(BASES[0])), U.absolute(F.lit("https://a.b/x"), F.lit(None).cast("string"))).first()[0:2] == (None, "https://a.b/x")


NORMAL = {
    "HTTPS://Exa.Example:443/a/../b": "https://exa.example/b", "http://a.example:80": "http://a.example/", "http://a.example:81?x": "http://a.example:81/?x", "https://u:p@a.example/x": "https://a.example/x",
    "https://münchen.example/bücher/straße?q=ü": "https://xn--mnchen-3ya.example/b%C3%BCcher/stra%C3%9Fe?q=%C3%BC", "https://例え.テスト/": "https://xn--r8jz45g.xn--zckzah/", "https://a.example/a b\\c": "https://a.example/a%20b/c", "https://a.example/%2e%2E/x~y": "https://a.example/x~y",
    "ftp://a.example/": None, "nothing": None, "": None, None: None,
}


def test_normal(spark):
    df = spark.createDataFrame([(u,) for u in NORMAL], "u string")
    assert {r["u"]: r["n"] for r in df.select("u", U.normal(F.col("u")).alias("n")).collect()} == NORMAL


def original(spark, url):
    return cdn.upgraded(spark.createDataFrame([(url,)], "url string")).first()["original"]


def test_rules_of_a_session(spark):
    mine, other = spark.newSession(), spark.newSession()
    url = "https://cdn.own.example/t/1.jpg?w=5"
    assert original(mine, url) == url
    cdn.register_rule(mine, "own", host=r"^cdn\.own\.example$", steps=[("sub", "^/t/", "/o/"), ("clear",)])
    assert original(mine, url) == "https://cdn.own.example/o/1.jpg" and original(other, url) == url
    # a session's rule comes before those that are built in, a lower priority before a higher one
    cdn.register_rule(mine, "late", host=r"^i\.pinimg\.com$", steps=[("sub", "^/236x/", "/late/")], priority=9)
    pin = "https://i.pinimg.com/236x/a.jpg"
    assert original(mine, pin) == "https://i.pinimg.com/late/a.jpg" and original(other, pin) == "https://i.pinimg.com/originals/a.jpg"
    cdn.register_rule(mine, "early", host=r"^i\.pinimg\.com$", path="a", steps=[("sub", "^/236x/", "/early/")], priority=1)
    assert original(mine, pin) == "https://i.pinimg.com/early/a.jpg"
    # one that is tied to no host
    cdn.register_rule(mine, "any", path="^/any/", steps=[("drop", ("w",))])
    assert original(mine, "https://x.example/any/1.jpg?w=1&k=2") == "https://x.example/any/1.jpg?k=2"
    for bad in ({"name": "own"}, {"name": "x", "host": "("}, {"name": "x", "host": None, "path": None}, {"name": "x", "host": r"^i\.pinimg\.com$", "priority": 9}, {"name": "x", "host": "^a$", "steps": [("call", "iiif")]}, {"name": "x", "host": "^a$", "steps": []}):
        with pytest.raises(ValueError):
            cdn.register_rule(mine, **({"host": "^z$", "steps": [("clear",)]} | bad))
    cdn.unregister_rule(mine, "early")
    cdn.unregister_rule(mine, "late")
    assert original(mine, pin) == original(other, pin)
    resolve.register_resolver(mine, "mine", "own.example", 3)
    named = lambda s: resolve.dispatch(s.createDataFrame([("https://cdn.own.example/1.jpg",)], "url string")).first()["resolver"]
    assert (named(mine), named(other)) == ("mine", "generic")
    with pytest.raises(ValueError):
        resolve.register_resolver(mine, "again", "own.example", 3)
