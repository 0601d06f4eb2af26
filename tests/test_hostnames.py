"""Host names outside ASCII against Python's codec."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pagecensus.functions.hostnames import ascii_host
from pagecensus.functions.urls import parse_or_assume_https


def encoded(label):
    return label if label.isascii() else "xn--" + label.encode("punycode").decode()


def hosts(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    return [r.h for r in rows.selectExpr(f"{ascii_host('name')} AS h").collect()]


def test_labels(spark):
    draw = random.Random(5)
    names = ["bücher", "例え", "ليهمابتكلموشعربي؟", "почемужеонинеговорятпорусски", "x😀y", "a-ü-b", "ä" * 60, "plain", ""]
    names += ["".join(draw.choice("abz019-äöéжщ日本😀ٱ￿") for _ in range(draw.randint(1, 40))) for _ in range(200)]
    assert hosts(spark, names) == [encoded(n) for n in names]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters=".。．｡"), min_size=1, max_size=20), min_size=20, max_size=40))
def test_any_text(spark, names):
    assert hosts(spark, names) == [encoded(n) for n in names]


def test_dots_and_addresses(spark):
    assert hosts(spark, ["über。例え．com", "a.ü.b"]) == ["xn--ber-goa.xn--r8jz45g.com", "a.xn--tda.b"]
    rows = spark.createDataFrame([("HTTPS://user@BÜCHER.example:443/ü?q",), ("bücher.example",)], "u string")
    got = [tuple(r) for r in rows.selectExpr(f"inline(array({parse_or_assume_https('u')}))").collect()]
    host = "https://xn--bcher-kva.example"
    assert [(url, origin) for url, origin, _ in got] == [
        ("https://user@xn--bcher-kva.example/%C3%BC?q", host), (f"{host}/", host),
    ]
