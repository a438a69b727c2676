"""Documents that Spark derives from the given tables: sitemaps, category and product pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pricetrail.functions import urls
from pricetrail.sources import star_schema as star

CHUNK = 50
INDEX_CHUNK = 2000
XMLNS = "http://www.sitemaps.org/schemas/sitemap/0.9"
PART_CHUNK = 300
MAX_PAGES = 5


def xml_escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _document(url: Column, root: str, entry: str, locs: Column, prefix: str = "") -> list[Column]:
    p = f"{prefix}:" if prefix else ""
    ns = f"xmlns:{prefix}" if prefix else "xmlns"
    items = F.array_join(
        F.transform(locs, lambda v: F.concat(
            F.lit(f"<{p}{entry}><{p}loc> "), xml_escape(v), F.lit(f" </{p}loc></{p}{entry}>"))),
        "\n",
    )
    body = F.concat(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<{p}{root} {ns}="{XMLNS}">'), items,
        F.lit(f"</{p}{root}>"),
    )
    return [
        url.alias("url"), F.lit(200).alias("status"),
        F.lit("application/xml; charset=utf-8").alias("content_type"), body.alias("body"),
    ]


def sited_pages(spark: SparkSession, root: str) -> DataFrame:
    pages = star.pages(spark, root).select("page_id", "url")
    return pages.withColumn("site", urls.host(F.col("url")))


def _file(name: str, number: Column) -> Column:
    return F.concat(F.lit("https://"), F.col("site"), F.lit(f"/{name}-"), number.cast("string"), F.lit(".xml"))


def sitemap_responses(spark: SparkSession, root: str) -> DataFrame:
    """Per host a root index, index files and urlset files of at most CHUNK urls."""
    pages = sited_pages(spark, root)
    chunk = F.floor(F.col("page_id") / CHUNK)
    index = F.floor(F.col("page_id") / INDEX_CHUNK)
    leaf_rows = pages.groupBy("site", chunk.alias("n")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda p: p["url"]
        ).alias("locs")
    )
    leaves = leaf_rows.select(*_document(_file("set", F.col("n")), "urlset", "url", F.col("locs")))
    index_rows = pages.groupBy("site", index.alias("n")).agg(
        F.array_sort(F.collect_set(chunk)).alias("chunks")
    )
    indexes = index_rows.select(
        *_document(_file("index", F.col("n")), "sitemapindex", "sitemap",
                   F.transform("chunks", lambda c: _file("set", c)), "sm")
    )
    root_rows = pages.groupBy("site").agg(F.array_sort(F.collect_set(index)).alias("parts"))
    roots = root_rows.select(
        *_document(F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap-index.xml")),
                   "sitemapindex", "sitemap", F.transform("parts", lambda c: _file("index", c)))
    )
    return leaves.unionByName(indexes).unionByName(roots)


CAPPED_CHUNK = 7
MAX_CAPPED, MAX_TOP = 40, 10


def capped_responses(spark: SparkSession, root: str) -> DataFrame:
    """Per host one index of many files: every fifth is an index of the first index again and of a leaf,
    every seventh can't be read."""
    chunk = F.floor(F.col("page_id") / CAPPED_CHUNK)
    files = sited_pages(spark, root).groupBy("site", chunk.alias("n")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda p: p["url"]).alias("locs")
    )
    top = F.concat(F.lit("https://"), F.col("site"), F.lit("/parts.xml"))
    nested, broken = F.col("n") % 5 == 4, F.col("n") % 7 == 6
    plain = files.where(~nested).select(*_document(_file("part", F.col("n")), "urlset", "url", F.col("locs")), broken.alias("_broken"))
    loops = files.where(nested).select(
        *_document(_file("part", F.col("n")), "sitemapindex", "sitemap", F.array(top, _file("leaf", F.col("n")))), broken.alias("_broken")
    )
    leaves = files.where(nested).select(*_document(_file("leaf", F.col("n")), "urlset", "url", F.col("locs")), F.lit(False).alias("_broken"))
    tops = files.groupBy("site").agg(F.array_sort(F.collect_list("n")).alias("parts")).select(
        *_document(top, "sitemapindex", "sitemap", F.transform("parts", lambda n: _file("part", n))), F.lit(False).alias("_broken")
    )
    every = plain.unionByName(loops).unionByName(leaves).unionByName(tops)
    return every.withColumn("status", F.when(F.col("_broken"), 500).otherwise(F.col("status"))).drop("_broken")


def capped_roots(spark: SparkSession, root: str) -> DataFrame:
    sites = sited_pages(spark, root).select("site").distinct()
    return sites.select("site", F.concat(F.lit("https://"), F.col("site"), F.lit("/parts.xml")).alias("sitemap_url"))


def sitemap_roots(spark: SparkSession, root: str) -> DataFrame:
    sites = sited_pages(spark, root).select("site").distinct()
    return sites.select(
        "site", F.concat(F.lit("https://"), F.col("site"), F.lit("/sitemap-index.xml")).alias("sitemap_url")
    )


def site_facts(spark: SparkSession, root: str) -> DataFrame:
    return sited_pages(spark, root).groupBy("site").agg(F.min("page_id").alias("m"))


def candidate_sites(spark: SparkSession, root: str) -> DataFrame:
    return site_facts(spark, root).select(
        "site", F.concat(F.lit("HTTPS://"), F.col("site"), F.lit("/sitemap-index.xml")).alias("configured_url")
    )


def candidate_robots(spark: SparkSession, root: str) -> DataFrame:
    host = F.concat(F.lit("https://"), F.col("site"))
    return site_facts(spark, root).select(
        F.concat(host, F.lit("/robots.txt")).alias("url"),
        F.when(F.col("m") % 11 == 0, 404).otherwise(200).alias("status"),
        F.concat(
            F.lit("User-agent: *\r\nDisallow: /x # Sitemap: no\r\nSitemap: "), host,
            F.lit("/a.xml # main\n  sitemap:"), host, F.lit("/b.xml\nSITEMAP: "), host,
            F.lit("/SITEMAP-index.xml\nSitemap:\n"),
        ).alias("body"),
    )


def candidate_responses(spark: SparkSession, root: str) -> DataFrame:
    host = F.concat(F.lit("https://"), F.col("site"))
    m = F.col("m")
    good = F.lit("<urlset><url><loc>https://x.example/1</loc></url></urlset>")
    bad = F.lit("<urlset><url>")
    html = F.lit("<!DOCTYPE html><title>404 Not Found</title>")

    def answer(name: str, status: Column, kind: Column, body: Column) -> Column:
        return F.struct(
            F.concat(host, F.lit(name)).alias("url"), status.alias("status"),
            kind.alias("content_type"), body.alias("body"),
        )

    xml = F.lit("text/xml")
    answers = F.array(
        answer("/sitemap-index.xml", F.when(m % 3 == 0, 404).otherwise(200), xml,
               F.when(m % 3 == 1, html).otherwise(good)),
        answer("/a.xml", F.when(m % 2 == 0, 429).otherwise(200), F.lit("text/plain"), good),
        answer("/b.xml", F.lit(200), xml, F.when(m % 5 == 0, good).otherwise(bad)),
        answer("/sitemap.xml", F.when(m % 7 == 0, 200).otherwise(500), xml, good),
    )
    return site_facts(spark, root).select(F.explode(answers).alias("r")).select("r.*")


# --- category pages -----------------------------------------------------------------


def _category_html(products: Column, next_href: Column) -> Column:
    cards = F.array_join(
        F.transform(products, lambda p: F.concat(
            F.lit('<li class="x Product-Card"><p><a href=" /item-'), p.cast("string"),
            F.lit('?utm=1&amp;a=2#top"><b>Item</b></a></p></li>'))),
        "",
    )
    return F.concat(
        F.lit('<html><body><nav><a href="/blog-news">Blog</a><a href="/other/page">O</a></nav><ul>'),
        cards,
        F.lit('<li class="product-card"><a href="https://else.example/item-1">x</a><a href="/customer">c</a></li></ul>'),
        F.coalesce(F.concat(F.lit('<a class="next" href="'), next_href, F.lit('">&raquo;</a>')), F.lit("")),
        F.lit("</body></html>"),
    )


def category_pages(spark: SparkSession, root: str) -> DataFrame:
    """Brand pages in key order and type pages in reverse, one page per PART_CHUNK keys."""
    parts = star.table(spark, root, "part")
    chunk = F.floor(F.col("p_partkey") / PART_CHUNK)
    last = parts.agg(F.max(chunk)).scalar()
    brand = parts.select(
        F.concat(F.lit("brand-"), F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("name"),
        chunk.alias("page"), "p_partkey",
    )
    kind = parts.select(
        F.concat(F.lit("type-"), F.lower("p_type")).alias("name"), (last - chunk).alias("page"), "p_partkey"
    )
    listed = brand.unionByName(kind).groupBy("name", "page").agg(
        F.array_sort(F.collect_list("p_partkey")).alias("items")
    ).withColumn("last", last)
    own = F.concat(F.lit(f"https://{star.SHOP}/"), F.col("name"))
    url = F.when(F.col("page") == 0, own).otherwise(
        F.concat(own, F.lit("?page="), F.col("page").cast("string"))
    )
    following = F.when(
        F.col("page") < F.col("last"),
        F.concat(F.lit("?page="), (F.col("page") + 1).cast("string"), F.lit("#list")),
    )
    gone = (F.col("name") == "brand-7") & (F.col("page") == 2)
    return listed.select(
        url.alias("url"), F.when(gone, 503).otherwise(200).alias("status"),
        F.lit("text/html").alias("content_type"),
        _category_html(F.col("items"), following).alias("html"),
    )


def pager_pages(spark: SparkSession, root: str) -> DataFrame:
    """A page for each of the given pages that marks its next page in one of ten ways, or not at all."""
    key = F.col("page_id").cast("string")
    way = F.col("page_id") % 11
    href = F.concat(F.lit(' href="?after='), key, F.lit('&amp;way='), way.cast("string"), F.lit('"'))

    def around(before: str, after: str) -> Column:
        return F.concat(F.lit(before), href, F.lit(after))

    marks = [
        around('<a rel="NEXT"', ">more</a>"), around('<a class="big next"', ">more</a>"),
        around('<div class="next"><p><em><a', ">more</a></em></div>"), around('<span class="pagination-next"', ">more</span>"),
        around('<li class="x pagination-next"><b><a', ">more</a></b></li>"), around('<button aria-label="Go to NEXT page"', ">more</button>"),
        around("<a", "> &gt; </a>"), around("<a", "><b>\u203a</b></a>"), around("<a", "><i></i>\n&raquo;</a>"), around("<a", ">the <u>Ne</u>xt one</a>"),
    ]
    mark = F.lit("")
    for number, html in enumerate(marks):
        mark = F.when(way == number, html).otherwise(mark)
    return star.pages(spark, root).select(
        "page_id", F.concat(F.lit('<!DOCTYPE html><body><!-- <a rel="next" href="/hidden"> --><div class="nextdoor"><a href="/a">before</a></div><ul><li class="prev"><a href="/b">1</a>'
                                  '<li>'), mark, F.lit('</ul><p class="next">end<p><a href="/c">after</a>')).alias("html"),
    )


def category_seeds(spark: SparkSession, root: str) -> DataFrame:
    """Brands first, then types, numbered inside one crawl."""
    parts = star.table(spark, root, "part")
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    brands = parts.select(
        number.cast("int").alias("seed_no"),
        F.concat(F.lit(f"https://{star.SHOP}/brand-"), number).alias("seed_url"),
    ).distinct()
    kinds = parts.select(
        (F.lit(1000) + F.ascii(F.substring("p_type", 1, 1)) * 200
         + F.ascii(F.substring("p_type", 2, 1))).alias("seed_no"),
        F.concat(F.lit(f"https://{star.SHOP}/type-"), F.lower("p_type")).alias("seed_url"),
    ).distinct()
    return brands.unionByName(kinds).select(F.lit(1).alias("crawl"), "seed_no", "seed_url")


# --- product pages ------------------------------------------------------------------


def product_pages(spark: SparkSession, root: str) -> DataFrame:
    """One rendered page per part, in four styles by size, with some failed fetches.

    Parts are few bytes, so a scan of them is a task or two: they are dealt out before they become pages.
    """
    parts = star.table(spark, root, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice").repartition("p_partkey", "p_name")
    key = F.col("p_partkey").cast("string")
    list_cents = star.cents(F.col("p_retailprice"))
    sale_cents = list_cents - F.col("p_size") * 100
    full = F.format_string("%d.%02d", F.floor(list_cents / 100), list_cents % 100)
    sale = F.format_string("%d.%02d", F.floor(sale_cents / 100), sale_cents % 100)
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    style = F.col("p_size") % 4
    head = F.concat(F.lit("<!DOCTYPE html><html><head><title> Buy  "), name, F.lit(" &amp; more</title>"))
    ld_plain = F.concat(
        F.lit('<script type="application/ld+json">{"@type":"Organization","name":"S"}</script>'),
        F.lit('<script data-x="1" type="application/ld+json">{"@context":"x","@type":"Product","name":" '), name,
        F.lit(' ","sku":"'), key, F.lit('","offers":{"@type":"Offer","price":'), full,
        F.lit(',"priceCurrency":"UAH"}}</script></head><body><h1>Other</h1><p>net '), size, F.lit(",5 кг</p></body></html>"),
    )
    ld_list = F.concat(
        F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'
              '[{"@type":"WebPage"},{"@type":["Thing","product"],"name":"'), name,
        F.lit('","sku":12,"offers":[{"price":null},{"price":"'), sale,
        F.lit('"}]}]</script></head><body><p>Артикул: '), key,
        F.lit('</p><script>var q = {"quantityText":"'), F.col("p_type"), F.lit("/"), size, F.lit('0г"};</script></body></html>'),
    )
    scraped = F.concat(
        F.lit("</head><body class=\"p\"><!-- 1 грн --><h1>Товар <b>"), name,
        F.lit("</b> &lt;new&gt;</h1><p>Код SKU: "), key, F.lit("</p><del>~~"), full,
        F.lit("~~</del> <span>"), F.translate(sale, ".", ","), F.lit(" грн</span><p>"), F.col("p_type"), F.lit(" à "), size, F.lit("5 мл</p></body></html>"),
    )
    inline = F.concat(
        F.lit("</head><body><h1>"), name, F.lit('</h1><p>Артикул '), key,
        F.lit('</p><script>window.x={"sku": "'), key,
        F.lit('","SQPP":{"price":'), full, F.lit(',"special_price":'), sale,
        F.lit(',"special_price_discount":7,"available":true,"special_price_from_date":"2026-01-05"}}</script>'
              "</body></html>"),
    )
    page = F.when(style == 0, ld_plain).when(style == 1, ld_list).when(style == 2, scraped).otherwise(inline)
    return parts.select(
        F.concat(F.lit(star.PRODUCT_ROOT), key).alias("url"),
        F.when(F.col("p_size") == 50, 404).when(F.col("p_size") == 49, 503)
        .when(F.col("p_size") == 48, 429).otherwise(200).alias("http_status"),
        (F.col("p_size") == 47).alias("timed_out"),
        F.when(F.col("p_size") == 46, F.lit("<html><body>nothing</body></html>"))
        .otherwise(F.concat(head, page)).alias("html"),
    )
