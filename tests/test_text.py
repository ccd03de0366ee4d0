import unicodedata

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import sender, text


def values(spark, xs, column):
    return [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(column.alias("y")).collect()]


def test_normalize_text(spark):
    assert values(spark, ["  “Hi” — it’s\n\tme ", None, "", "a​b"], text.normalize_text(F.col("x"))) == ['"hi" - it\'s me', None, "", "ab"]


def test_normalize_text_folds_case(spark):
    xs = ["STRAẞE Straße", "ΣΑΣ ς", "ſoon", "ΐ plain", "İ"]
    got = values(spark, xs[:3], text.normalize_text(F.col("x")))
    assert got == [x.casefold() for x in xs[:3]]


def test_collapse_whitespace_is_idempotent(spark):
    xs = ["a \r\n\r\n\r\n\r\n b\tc \n", " x­y  z", "", " \n "]
    once = values(spark, xs, text.collapse_whitespace(F.col("x")))
    assert once == ["a\n\nb c", "xy z", "", ""] and values(spark, once, text.collapse_whitespace(F.col("x"))) == once


def test_html_to_text(spark):
    page = "<html><head><title>t</title><style>p{}</style></head><body><p>thank you for <b>apply</b>ing</p><table><tr><td>a</td><td>b &amp;lt;</td></tr></table><script>x</script>end</body>"
    assert values(spark, [page, None], text.html_to_text(F.col("x"))) == ["thank you for applying\n\na b &lt;\n\nend", None]


COMPANIES = {"The Acme Robotics, Inc.": "acme robotics", "Zürich Data GmbH": "zurich data", "Co": "co", "A & B Company LLC": "a and b", "Inc": "inc", "The": "the", "...": None, "": None}


def test_company_key(spark):
    key = text.company_key(text.fold_accents(F.col("x")))
    got = values(spark, list(COMPANIES), key)
    assert got == list(COMPANIES.values())
    assert values(spark, [x for x in got if x], key) == [x for x in got if x]


def test_role_key(spark):
    roles = {"Sr. SWE II (REQ-12345)": "software engineer", "Senior": "senior", "The Lead Designer #77": "designer", "ML Eng JR0012345": "machine learning engineer"}
    assert values(spark, list(roles), text.role_key(F.col("x"))) == list(roles.values())


@pytest.mark.parametrize("a, b, expected", [("Sr. SWE", "Software Engineer", 1.0), ("data analyst", "data engineer", 0.5), (None, "x", 0.0), ("Senior", "Senior", 0.0), ("full-time cook", "cook", 1.0)])
def test_dice(spark, a, b, expected):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.dice(text.link_tokens(F.col("a")), text.link_tokens(F.col("b"))).alias("d")).first()
    assert row.d == expected


def test_role_similarity_is_symmetric_and_bounded(spark):
    titles = ["Software Engineer", "Data Engineer", "Designer", "Senior Data Engineer"]
    rows = spark.createDataFrame([(a, b) for a in titles for b in titles], "a string, b string").select("a", "b", text.role_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    s = {(r.a, r.b): r.s for r in rows}
    assert all(0 <= x <= 1 for x in s.values()) and s["Data Engineer", "Senior Data Engineer"] == 1.0 and s["Designer", "Designer"] == 1.0


def test_strip_accents_matches_the_standard_library(spark):
    xs = ["Ünïcödé", "ǅ", "Straße", "plain"]
    assert values(spark, xs, text.strip_accents(F.col("x"))) == ["".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").casefold() for x in xs]


def test_fold_accents_agrees_on_latin_text(spark):
    xs = ["Ünïcödé Żółw", "Straße", "é", "Ệ", None]
    assert values(spark, xs, text.fold_accents(F.col("x"))) == values(spark, xs, text.strip_accents(F.col("x")))


def test_vendor_needs_a_label_boundary_and_takes_the_longest(spark):
    hosts = {"mail.greenhouse.io": "greenhouse", "greenhouse.io": "greenhouse", "notgreenhouse.io": None, "hire.lever.co": "lever", "x.angel.co": "wellfound"}
    assert values(spark, list(hosts), sender.vendor_of_host(F.col("x"))) == list(hosts.values())


def test_clean_sender_name(spark):
    names = {"Jane from Acme Robotics": "Acme Robotics", "Acme Careers Team": "Acme", "Acme (via Greenhouse)": "Acme", "Talent Acquisition": None, "lever": None, " ": None, None: None}
    assert values(spark, list(names), sender.clean_sender_name(F.col("x"))) == list(names.values())


def test_sender_domain_label(spark):
    mails = {"a@careers.acme.com": "acme", "a@gmail.com": None, "a@x.lever.co": None, "a@localhost": None, "nobody": None}
    assert values(spark, list(mails), sender.sender_domain_label(F.col("x"))) == list(mails.values())
