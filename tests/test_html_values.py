"""Values of ordinary HTML that the derived inputs do not hold."""

import pytest
from pyspark.sql import functions as F

from pagetide.functions import html as H
from pagetide.operators import elements as E
from pagetide.operators import profile as R
from pagetide.operators import state
from pagetide.operators.content import parse_date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("written, read", [
    ("caf&eacute; &uuml;ber &frac12;", "café über ½"),
    ("a &amp;amp; b &nosuch; &", "a &amp; b &nosuch; &"),
    ("&there4;&sup2;&Alpha;", "∴²Α"),
    ("&#233;&#x1F600;&#00000000233;", "é😀é"),
    ("&#0;&#xD800;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFFFF;", "�" * 4),
])
def test_references(spark, written, read):
    assert one(spark, H.decode_entities(F.lit(written))) == read


@pytest.mark.parametrize("token, names, values", [
    ("<a href=https://e.example/>", ["href"], ["https://e.example/"]),
    ("<a href=https://e.example/ />", ["href"], ["https://e.example/"]),
    ('<img src="a"/>', ["src"], ["a"]),
    ("<img src='a' alt=b/c hidden/>", ["src", "alt", "hidden"], ["a", "b/c", ""]),
    ("<br/>", [], []),
    ("<p CLASS=one class='two &eacute;'>", ["class", "class"], ["one", "two é"]),
])
def test_attributes(spark, token, names, values):
    row = spark.range(1).select(H.attribute_names(F.lit(token)).alias("n"), H.attribute_values(F.lit(token)).alias("v")).first()
    assert row.n == names and [v or "" for v in row.v] == values


@pytest.mark.parametrize("written, instant", [
    ("5 Jan 2024", "2024-01-05 00:00:00"),
    ("Fri Jan 05 2024", "2024-01-05 00:00:00"),
    ("Fri, 05 Jan 2024 10:00:00 GMT", "2024-01-05 10:00:00"),
    ("2024-01-05T10:00:00.123456Z", "2024-01-05 10:00:00.123456"),
    ("2024-01-05T10:00:00+0900", "2024-01-05 01:00:00"),
    ("2024-01-05T10:00:00.5+09:00", "2024-01-05 01:00:00.5"),
    ("January 5, 2024", "2024-01-05 00:00:00"),
    ("soon", None),
])
def test_dates(spark, written, instant):
    assert one(spark, parse_date(F.lit(written)).cast("string")) == instant


def test_limits_are_parameters(spark):
    html = "<body>" + "".join(f"<p class='c{i}' id='i{i}'>x</p>" for i in range(120)) + "<a href='/u'>" + "y" * 300 + "</a></body>"
    els = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), tree=True)
    row = R.page_structure(els).first()
    assert (row.available_classes, row.unique_selectors) == (120, 240)
    row = R.page_structure(els, max_classes=50, max_selectors=100).first()
    assert (row.available_classes, row.unique_selectors) == (50, 100)
    assert [len(R.link_elements(els, text_chars=n).first().text) for n in (100, None)] == [100, 300]


def test_details_of_one_address_do_not_double_a_release(spark):
    releases = spark.createDataFrame([("1.1", "t", "/a", None, None)], "version string, title string, url string, content string, image_url string")
    store = spark.createDataFrame([], "version string, title string, url string, published_at timestamp_ntz, content string, image_url string, local_image_path string")
    details = spark.createDataFrame([("/a", "old", "i", 1), ("/a", "new", "j", 2)], "url string, content string, image_url string, fetched_at int")
    rows = state.enrich(releases, store, details).collect()
    assert [(r.content, r.image_url) for r in rows] == [("new", "j")]
