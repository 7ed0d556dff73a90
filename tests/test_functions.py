"""Column functions on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import markup, masks, text, values
from gleaner.functions.nested import html_to_markdown_nested


def one(spark, column, **row):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in row.items())
    return spark.createDataFrame([tuple(v for _, v in row.values())], schema).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("age,hours", [("12h", 12), ("3d", 72), ("2w", 336), ("1mo", 730), ("1y", 8760), ("5q", None)])
def test_age(spark, age, hours):
    assert one(spark, values.age_to_hours("c"), c=("string", age)) == hours


@pytest.mark.parametrize("pay,lower,upper", [
    ("$100k-$150k/yr", 100, 150), ("$10k-$12k/mo", 120, 144), ("$120k/yr", 120, 120), ("-", None, None),
    ("$50-$60/hr", 10.4, 12.48), ("$1k-$2k/wk", 0, 0),
])
def test_salary_slices(spark, pay, lower, upper):
    got = one(spark, values.salary_bounds("c"), c=("string", pay))
    assert got.lower == (None if lower is None else pytest.approx(lower))
    assert got.upper == (None if upper is None else pytest.approx(upper))


@pytest.mark.parametrize("pay,lower,upper", [
    ("$50-$60/hr", 104, 124.8), ("$1k-$2k/wk", 52, 104), ("$100,000-$1.2m/yr", 100, 1200), ("-", None, None),
])
def test_salary_numbers(spark, pay, lower, upper):
    got = one(spark, values.salary_bounds("c", strict_slice=False), c=("string", pay))
    assert got.lower == (None if lower is None else pytest.approx(lower))
    assert got.upper == (None if upper is None else pytest.approx(upper))


@pytest.mark.parametrize("raw,number", [("5+ YOE", 5), ("-", None), ("3 YOE", None), ("1d", None), (" 2.5 +", 2.5)])
def test_leading_number(spark, raw, number):
    assert one(spark, values.leading_number("c"), c=("string", raw)) == number


@pytest.mark.parametrize("company,title,name", [
    ("Acme", 'Data "AI"/ML  Lead', "Acme - Data 'AI'_ML Lead"), (None, "X", "- X"), ("A", None, None),
    ("A|B", "c:d?*\\e", "A_B - c_d___e"),
])
def test_position_name(spark, company, title, name):
    assert one(spark, text.position_name("c", "t"), c=("string", company), t=("string", title)) == name


def test_locations(spark):
    assert one(spark, text.shorten_location("c"), c=("string", "Oakland, California, United States")) == "Oakland"
    cities = ["San Francisco", "South San Francisco", "Oakland", "St. Helena"]
    hits = one(spark, text.dictionary_hits("c", cities), c=("string", "South San Francisco or Oakland, StX Helena"))
    assert hits == ["South San Francisco", "Oakland"]
    assert one(spark, text.dictionary_hits("c", cities), c=("string", "Remote")) is None


def test_splits(spark):
    assert one(spark, text.before_last("c", "."), c=("string", "A - B.c.abc123")) == "A - B.c"
    assert one(spark, text.after_last("c", "."), c=("string", "A - B.c.abc123")) == "abc123"
    assert one(spark, text.after_last("c", "."), c=("string", "plain")) is None
    assert one(spark, text.key_from_log("c"), c=("string", "Skip A. B.k1.html.pkl")) == "k1"
    assert one(spark, text.key_from_log("c"), c=("string", "Skip A.k1.md")) == "k1"
    assert one(spark, text.key_from_log("c"), c=("string", "none")) is None


def test_characters(spark):
    assert one(spark, text.normalise_chars("c"), c=("string", "a b​c d’e")) == "a b c d'e"
    assert one(spark, text.clean_company("c"), c=("string", 'A "B" C’s::')) == "A 'B' C's:"
    assert one(spark, text.strip("c"), c=("string", "  a b\t ")) == "a b"
    assert one(spark, text.collapse_space("c"), c=("string", "a  \n b")) == "a b"


@pytest.mark.parametrize("days,weight", [(0, 1.0), (10, 0.9), (99, 0.01), (150, 0.0)])
def test_recency(spark, days, weight):
    newest = F.lit("2026-06-01 12:00:00").cast("timestamp_ntz")
    published = newest - F.make_dt_interval(F.lit(days))
    assert one(spark, values.recency_weight(published, newest), c=("int", 1)) == pytest.approx(weight)


def test_whole_days(spark):
    newest = F.lit("2026-06-02 01:00:00").cast("timestamp_ntz")
    published = F.lit("2026-06-01 23:00:00").cast("timestamp_ntz")
    assert one(spark, values.recency_weight(published, newest), c=("int", 1)) == 1.0


def test_smart_case(spark):
    def hit(phrase, body, regex=False):
        return one(spark, masks.regex_mask(phrase, "c", regex), c=("string", body))

    assert hit("ml", "HTML ML-ops") and not hit("ml", "HTML")
    assert hit("ML", "a ML b") and not hit("ML", "HTML ml ml-ops")
    assert hit("a|b", "xb")  # the border binds to the first alternative only
    assert not hit("a|b", "xa")
    assert not hit("a", "éa")  # an accented letter is a word character
    assert hit("t.l", "HTML", regex=True)
    assert one(spark, masks.regex_mask("x", "c"), c=("string", None)) is False


def test_list_masks(spark):
    tools = ("array<string>", ["Python", "R"])
    assert one(spark, masks.element_mask("py", "c"), c=tools) is True
    assert one(spark, masks.element_mask("thon", "c"), c=tools) is False
    assert one(spark, masks.element_mask("x", "c"), c=("array<string>", None)) is False
    df = spark.createDataFrame([(["SQL"], "Health care", None)], "tools array<string>, area string, gone string")
    row = df.select(
        masks.keyword_equals_mask(df, "sql", "tools").alias("a"), masks.keyword_equals_mask(df, "sql", "tools", case=True).alias("b"),
        masks.keyword_mask(df, ["health", "medical"], "area").alias("c"), masks.keyword_mask(df, "care", "gone").alias("d"),
        masks.keyword_mask_any(df, "sql", ["gone", "area", "tools"]).alias("e"), masks.overlaps("tools", []).alias("f"),
    ).first()
    assert tuple(row) == (True, False, True, False, True, False)


def test_box_pairs(spark):
    def inside(lat, lon):
        return one(spark, masks.in_box("a", "o", masks.HOME_BOX), a=("array<double>", lat), o=("array<double>", lon))

    assert inside([10.0, 38.0], [0.0, -122.0]) is True
    assert inside([38.0, 0.0], [0.0, -122.0]) is False
    assert inside([37.0], [-121.0]) is True
    assert inside(None, None) is False
    assert inside([38.0, None], [None, -122.0]) is False


def test_title_class(spark):
    def fits(title):
        return one(spark, masks.title_class("c"), c=("string", title))

    assert fits("Senior Data Scientist") and fits("ML Platform Engineer")
    assert not fits("Software Data Engineer") and not fits("HTML engineer") and not fits(None)


def test_radius(spark):
    centre = (37.77493, -122.41942)
    near = masks.within_miles("a", "o", centre, 50)
    assert one(spark, near, a=("double", 37.3382), o=("double", -121.8863)) is True  # San Jose
    assert one(spark, near, a=("double", 38.5816), o=("double", -121.4944)) is False  # Sacramento
    assert one(spark, near, a=("double", None), o=("double", 0.0)) is False


HTML = (
    "<html><head><title>T</title><script>x('</p>')</script></head><body><h2>Role &amp; team</h2><p>We <b>build</b>\n things<br>daily</p>"
    '<ul><li>one</li><li><a class="k" href="/u">two</a></li></ul><!-- no --></body></html>'
)


def test_markdown_of_markup(spark):
    want = "## Role & team\n\nWe **build** things  \ndaily\n\n* one\n* [two](/u)"
    assert one(spark, markup.html_to_markdown("c"), c=("string", HTML)) == want
    assert one(spark, html_to_markdown_nested("c"), c=("string", HTML)) == want


def test_nested_lists_keep_depth(spark):
    html = "<ol><li>a<ul><li>b</li></ul></li><li>c</li></ol>"
    assert one(spark, html_to_markdown_nested("c"), c=("string", html)) == "1. a\n\t* b\n2. c"


def test_scripts_and_kinds(spark):
    page = '<title>All (N=3)</title><script>a</script><script id="__NEXT_DATA__">{"k": 1}</script>'
    assert one(spark, markup.script_text("c"), c=("string", page)) == '{"k": 1}'
    assert one(spark, markup.script_text("c"), c=("string", "<p>")) is None
    assert one(spark, markup.is_company_page("c"), c=("string", page)) is False
    assert one(spark, markup.is_company_page("c"), c=("string", "<title>Acme</title>")) is True
    assert one(spark, markup.is_company_page("c"), c=("string", "<p>")) is False
    assert one(spark, markup.company_key("c"), c=("string", "/?company=ac#me&p=1")) == "ac#me"


def test_nan(spark):
    df = values.nan_to_null(spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, y string"))
    assert [r.x for r in df.orderBy("y").collect()] == [None, 1.0]
