import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as T


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "make, given, expected",
    [
        (T.decode_entities, "a &amp; b &sect; c &mdash; d &ndash; e", "a & b § c — d – e"),
        (T.decode_entities, "&amp;lt;", "&lt;"),
        (T.escape_html, 'a & b < c > d "e"', "a &amp; b &lt; c &gt; d &quot;e&quot;"),
        (T.links, "[[Foo]] text [[Bar|display]] [[Foo]] [[A &amp; B]]", ["Foo", "Bar", "A & B"]),
        (T.links, "[[" + "x" * 250 + "]] [[Keep]]", ["Keep"]),
        (T.file_candidates, 'a/b:c?d"e', ['a/b:c?d"e', 'a___b:c?d"e', 'a/b%3Ac?d"e', 'a/b:c%3Fd"e', "a/b:c?d%22e"]),
        (T.route_slug, "Hello §World_x", "hello-sectionworld_x"),
        (T.route_slug, "Café ™ Zed", "cafe-TM-zed"),
        (T.route_slug, "", ""),
        (T.vault_title, "Weir / mill / sluice — how the water turns", "Weir, mill, sluice — how the water turns"),
        (T.vault_title, "Or/And", "Or-And"),
        (T.vault_title, "Quern + millrace: what they grind", "Quern + millrace - what they grind"),
        (T.tags, "tags:: alpha, beta, gamma", ["alpha", "beta", "gamma"]),
        (T.tags, "tags:: [[a b]], [[c]]", ["a b", "c"]),
        (T.tags, "no tags", []),
        (T.image_assets, "![](../assets/x.jpg) ![](./assets/y.png) ![a](assets/z.webp) ![](../../assets/nested.gif)", ["x.jpg", "y.png", "z.webp", "nested.gif"]),
        (T.image_assets, "![](/assets/x.jpg) ![](https://h/assets/y.jpg)", []),
        (T.region_slug, "It's a Test — ok", "its-a-test-ok"),
        (T.key_slug, "A b/C", "a-b-c"),
        (T.file_stem, "a.mdx", "a"),
        (T.without_leading_properties, "a:: 1\nb_c:: 2\n\nbody\nd:: 3", "body\nd:: 3"),
        (T.without_leading_properties, "text\na:: 1", "text\na:: 1"),
        (T.properties, "Type:: note\ntype:: x\ntype:: y\n\nz:: no", {"Type": "note", "type": "y"}),
        (T.properties, "a:: 1\r\nb:: 2", {}),
        (T.property_body, "\n\na:: 1\n\nbody", "body"),
        (T.property_body, "\n\nbody", "body"),
        (T.json_quote, 'a "b"\n', '"a \\"b\\"\\n"'),
        (T.normalized, "a  b \r\n\n\n c\n", "a b\nc"),
        (T.strip_blank, " ﻿a　", "a"),
    ],
)
def test_scalars(spark, make, given, expected):
    assert one(spark, given, make) == expected


def test_empty_property_takes_the_next_line(spark):
    assert one(spark, "tags::\nnext line", lambda c: T.first_property(c, "tags")) == "next line"
    assert one(spark, "x", lambda c: T.first_property(c, "tags")) is None


def test_nulls(spark):
    for make in (T.links, T.route_slug, T.vault_title, T.properties, T.normalized, T.image_assets):
        assert one(spark, None, make) is None


def test_hash_ignores_blanks(spark):
    assert one(spark, "a  b\n\n\nc ", T.content_hash) == one(spark, "a b\nc", T.content_hash)
    assert len(one(spark, "a", T.content_hash)) == 16
