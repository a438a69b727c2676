import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricetrail.functions import display, fetch, parsing, pricing, status, text, urls


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def evaluate(spark, fn, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", fn(F.col("v")).alias("r"))
    return [r["r"] for r in sorted(df.collect())]


def test_trim(spark):
    given = [None, "   ", "  abc  ", "\tab "]
    assert evaluate(spark, lambda c: text.trim_nullable(c, 2), given) == [None, None, "ab", "\ta"]
    assert evaluate(spark, lambda c: text.trim_required(c, 2), given) == ["", "", "ab", "\ta"]
    assert evaluate(spark, lambda c: text.strip_and_cut(c, 2), given) == ["", "", "ab", "ab"]
    assert evaluate(spark, text.strip, ["　a "]) == ["a"]


def test_status_words(spark):
    given = [None, " OK ", "Running", "done", "reserved"]
    assert evaluate(spark, status.run_status, given) == ["error", "ok", "running", "error", "error"]
    assert evaluate(spark, status.queue_status, [None, " Dead ", "x", "RESERVED"]) == [
        "pending", "dead", "pending", "reserved"]
    assert [status.scope_name(s) for s in (None, " Failed", "SUCCESSFUL ", "x")] == [
        "all", "failed", "successful", "all"]


def test_missing_issue_has_defaults(spark):
    kind = "struct<stage:string,error_code:string,http_status:int,message:string,is_transient:boolean>"
    df = spark.createDataFrame(
        [(None,), ((" Fetch ", "http_5xx", 503, "  m ", True),), (("", "Timeout", None, None, None),)],
        f"i {kind}",
    )
    got = [tuple(r["n"]) for r in df.select(status.normalize_issue(F.col("i"), True).alias("n")).collect()]
    assert got == [
        ("extract", "unknown", None, "", False, True),
        ("fetch", "http_5xx", 503, "m", True, True),
        ("extract", "unknown", None, "", False, True),
    ]


@pytest.mark.parametrize(
    "price, old, one_dp, zero_dp",
    [("19.90", "24.50", D("18.8"), 19), ("49.90", "59.90", D("16.7"), 17), (None, "5", None, None),
     ("5", "5", None, None), ("5", "0", None, None), ("7.00", "8.00", D("12.5"), 13),
     ("99999", "100000", D("0.0"), 0)],
)
def test_discount(spark, price, old, one_dp, zero_dp):
    row = (price and D(price), D(old))
    kind = "p decimal(18,2), o decimal(18,2)"
    assert one(spark, pricing.discount_percent(F.col("p"), F.col("o")), kind, row) == one_dp
    assert one(spark, pricing.grid_discount_percent(F.col("p"), F.col("o")), kind, row) == zero_dp


def test_price_change_keeps_sign_and_ignores_zero_base(spark):
    kind = "b decimal(18,2), t decimal(18,2)"
    change = pricing.price_change_percent(F.col("b"), F.col("t"))
    assert one(spark, change, kind, (D("21.50"), D("19.90"))) == D("-7.4")
    assert one(spark, change, kind, (D("0"), D("19.90"))) is None
    assert one(spark, change, kind, (D("8"), D("8.004"))) == D("0.0")


def test_display(spark):
    kind = "v decimal(18,6), u string"
    rows = [((D("1.5"), "kg"), "1.5 kg"), ((D("400"), None), "400"), ((None, " pcs"), " pcs"),
            ((None, "  "), None), ((D("0.1254"), "l"), "0.125 l"), ((D("0"), ""), "0")]
    for row, expected in rows:
        assert one(spark, display.format_unit(F.col("v"), F.col("u")), kind, row) == expected


def test_retry_policy(spark):
    kind = "a int, j int"
    wait = fetch.backoff_ms(F.col("a"), F.lit(500), F.lit(5000), F.col("j"))
    assert [one(spark, wait, kind, r) for r in ((1, 0), (2, 0), (10, 0), (2, 123))] == [500, 1000, 5000, 1123]
    decide = fetch.retry_action(F.col("t"), F.col("a"), F.col("m"))
    kind = "t boolean, a int, m int"
    got = [one(spark, decide, kind, r) for r in ((True, 1, 3), (True, 2, 3), (True, 3, 3), (False, 1, 3))]
    assert got == ["Retry", "Retry", "Dead", "Dead"]


def test_sitemap_kinds(spark):
    from pricetrail.sources.documents import sitemap_documents

    rows = [
        (404, "text/html", "<!doctype html><html><title>404 Not Found</title>", "NotFound"),
        (403, "text/html", "forbidden", "Forbidden"),
        (200, "text/html", "<html><title>404 Not Found</title>", "HtmlInsteadOfXml"),
        (200, "text/plain", "<urlset></urlset>", "InvalidContentType"),
        (200, "application/xml", "<urlset>", "InvalidXml"),
        (200, "application/xml", "", "EmptyBody"),
        (500, "text/html", "server error", "ServerError"),
        (429, "text/html", "rate limited", "RateLimited"),
        (302, "text/html", "", "UnexpectedStatusCode"),
        (200, "application/xml", "<feed></feed>", "InvalidXml"),
        (200, "application/xml", "<?xml version='1.0'?><!-- x --><urlset/>", None),
        (200, "text/xml", "<s:sitemapindex xmlns:s='u'><s:sitemap><s:loc>http://a</s:loc></s:sitemap></s:sitemapindex>", None),
    ]
    df = spark.createDataFrame([(str(i), *r[:3]) for i, r in enumerate(rows)],
                               "url string, status int, content_type string, body string")
    got = {int(r["url"]): r for r in sitemap_documents(df).collect()}
    assert [got[i]["failure_kind"] for i in range(len(rows))] == [r[3] for r in rows]
    assert got[11]["root"] == "sitemapindex" and got[11]["locs"] == ["http://a"]


def test_urls(spark):
    given = [
        "HTTPS://Shop.Example:443/Картопля?x=1#f", "http://a.example", "https://a.example/x/../b/./c/..",
        "not a url", "http://a.example:8080/a b?q=é", "mailto:x", "http://u@a.example/%D0%B0", "https:///p",
    ]
    assert evaluate(spark, urls.product_url, given) == [
        "https://shop.example/%D0%9A%D0%B0%D1%80%D1%82%D0%BE%D0%BF%D0%BB%D1%8F", "http://a.example/",
        "https://a.example/b/", None, "http://a.example:8080/a%20b", "mailto://x", "http://u@a.example/%D0%B0", None,
    ]
    assert evaluate(spark, lambda c: urls.page_url(c), given[4:5]) == ["http://a.example:8080/a%20b?q=%C3%A9"]
    assert evaluate(spark, urls.slug, ["https://a.example/x/y/?q", "https://a.example/", "x/y"]) == ["y", None, None]
    base = F.lit("https://a.example/c/d?page=1")
    hrefs = ["?page=2", "e", "/e", "//b.example/e", "../e", "http://z.example", "#top", "  ", "../../../e"]
    assert evaluate(spark, lambda c: urls.resolve(c, base), hrefs) == [
        "https://a.example/c/d?page=2", "https://a.example/c/e", "https://a.example/e", "https://b.example/e",
        "https://a.example/e", "http://z.example/", "https://a.example/c/d?page=1#top",
        "https://a.example/c/d?page=1", "https://a.example/e"]
    category = F.lit("https://a.example/veg")
    looks = ["https://a.example/p-1", "https://a.example/VEG", "https://a.example/a/b", "https://a.example/",
             "https://a.example/Blog1", "https://a.example/rukola", "https://a.example/brand"]
    assert evaluate(spark, lambda c: urls.looks_like_product(c, category), looks) == [
        True, False, False, False, False, False, True]


def test_idempotency_key_is_the_sha_of_run_and_url(spark):
    import hashlib

    assert one(spark, urls.idempotency_key(F.lit(7), F.lit(" u "))) == hashlib.sha256(b"7:u").hexdigest()


def told_numbers(rng, n):
    """Numbers as pages write them, beside what they mean."""
    for _ in range(n):
        whole, part = rng.randint(1, 4000), rng.choice(["", f"{rng.randint(1, 9)}", f"{rng.randint(10, 99)}"])
        shown = f"{whole:,}".replace(",", " ") if rng.random() < 0.5 else str(whole)
        yield shown + (rng.choice(",.") + part if part else ""), D(f"{whole}.{part}" if part else whole)


def test_amounts_beside_units(spark):
    rng = random.Random(21)
    cases = []
    for unit in parsing.PACK_UNITS:
        for shown, value in told_numbers(rng, 6):
            tail = rng.choice(["", " net", "; x"])
            cases.append((f"{rng.choice(['item', 'goods -', ''])} {shown} {rng.choice([unit, unit.upper()])}{tail}", value, unit))
    got = evaluate(spark, lambda c: parsing.pack(c, F.lower(c)), [c[0] for c in cases])
    assert [(g["value"], g["unit"]) for g in got] == [c[1:] for c in cases]
    assert evaluate(spark, lambda c: parsing.pack(c, F.lower(c)), ["item", "4 boxes"]) == [None, None]


def test_quoted_quantity_wins(spark):
    rng = random.Random(22)
    cases = []
    for _ in range(12):
        amount, unit, packs = rng.randint(1, 900), rng.choice(parsing.PACK_UNITS), rng.randint(2, 40)
        told = rng.choice([f"{amount}{unit} x {packs}", f"{packs} x {amount} {unit}", f"box/{amount} {unit}"])
        key = rng.choice(["quantityText", "QuantityText", "QUANTITYTEXT"])
        cases.append((f'9 {unit} {{"a":1,"{key}"{rng.choice([":", " : "])}"{told}"}}', D(amount), told))
    cases.append(('{"quantityText":"each"}', None, "each"))
    got = evaluate(spark, lambda c: parsing.pack(c, F.lower(c)), [c[0] for c in cases])
    assert [(g["value"], g["unit"]) for g in got] == [c[1:] for c in cases]


def test_marked_amounts_and_ids(spark):
    rng = random.Random(23)
    shown, prices, struck, old, marked, ids = [], [], [], [], [], []
    for text, value in told_numbers(rng, 20):
        marker = rng.choice(parsing.MONEY_MARKERS)
        shown.append(f"{rng.choice(['now', '-', 'a: '])} {text}{marker}")
        prices.append(value)
        struck.append(f"was ~~{text}~~ and {marker}")
        old.append(value)
        number = str(rng.randint(1, 10**9))
        marked.append(f"q {rng.choice(parsing.ID_MARKERS)}{' ' * rng.randint(0, 3)}{number} z")
        ids.append(number)
    assert evaluate(spark, lambda c: parsing.text_price(F.lower(c)), shown) == prices
    assert evaluate(spark, parsing.text_old_price, struck) == old
    assert evaluate(spark, lambda c: parsing.marked_id(F.lower(c)), marked) == ids
    # Of several marked amounts the first marker of the list decides; what is no number is no price.
    first, last = parsing.MONEY_MARKERS[0], parsing.MONEY_MARKERS[-1]
    assert evaluate(spark, lambda c: parsing.text_price(F.lower(c)), [f"1{last} 2{first}", "free", f"8.8.8{first}"]) == [D("2"), None, None]


def test_shown_amounts(spark):
    values = [D("-1.60"), D("0"), D("1234.5"), None]
    assert evaluate(spark, pricing.signed_price_text, values, "decimal(18,2)") == [
        "-1.60 UAH", "0.00 UAH", "+1,234.50 UAH", "No change"]
    assert evaluate(spark, pricing.tone, values, "decimal(18,2)") == ["success", "neutral", "accent", "muted"]
    assert evaluate(spark, lambda c: pricing.coverage_text(c, F.lit(3)), [2, 0], "int") == ["67%", "0%"]
    assert evaluate(spark, lambda c: pricing.coverage_text(F.lit(1), c), [0], "int") == ["Not available"]
