"""URL canonical form and URL rules (P19-P26), as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pricetrail import schemas as S
from pricetrail.functions import text
from pricetrail.functions.bind import let

# scheme : // user@ host :port path ?query #fragment
_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*):(?://((?:[^/?#@]*@)?)([^/?#:]*)(?::([0-9]*))?)?([^?#]*)(\?[^#]*)?(#.*)?$"
_NEEDS_ESCAPE = r'[^\x21-\x7E]|["<>\\^`{|}]'


_FIELDS = ("scheme", "user", "host", "port", "path", "query", "fragment")


def parts(url: Column) -> Column:
    """Struct of the URL's parts as written, scheme and host in lower case."""

    def split(clean: Column) -> Column:
        found = [F.regexp_extract(clean, _PARTS, i + 1) for i in range(len(_FIELDS))]
        found[0], found[2] = F.lower(found[0]), F.lower(found[2])
        return F.struct(*[c.alias(n) for c, n in zip(found, _FIELDS)])

    return let(text.strip(url), split)


def _absolute(p: Column) -> Column:
    web = p["scheme"].isin("http", "https")
    return F.coalesce((p["scheme"] != "") & (~web | (p["host"] != "")), F.lit(False))


def is_absolute(url: Column) -> Column:
    """An absolute URL; web schemes must also name a host."""
    return let(parts(url), _absolute)


def host(url: Column) -> Column:
    return parts(url)["host"]


def _path(p: Column) -> Column:
    return F.when(p["path"] == "", "/").otherwise(p["path"])


def percent_encode(value: Column) -> Column:
    """Escape what may not stand in a URL as UTF-8 %XX; existing escapes stay."""
    escaped = F.transform(
        F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)),
        lambda c: F.when(
            c.rlike(_NEEDS_ESCAPE), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
        ).otherwise(c),
    )
    return F.when(value.rlike(_NEEDS_ESCAPE), F.array_join(escaped, "")).otherwise(value)


def remove_dot_segments(value: Column) -> Column:
    """Resolve ``.`` and ``..`` path segments left to right."""
    segments = F.split(F.regexp_replace(value, r"^/", ""), "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == ".", kept)
        .when(s == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(s))),
    )
    open_end = F.when(value.rlike(r"/\.\.?$") & (F.size(folded) > 0), "/").otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(folded, "/"), open_end)
    return F.when(value.rlike(r"/\.\.?(/|$)"), clean).otherwise(value)


def canonical(url: Column, keep_query: bool = True, keep_fragment: bool = True) -> Column:
    """Lower-case scheme and host, drop the default port, resolve and escape the path."""

    def build(p: Column) -> Column:
        default = ((p["scheme"] == "https") & (p["port"] == "443")) | (
            (p["scheme"] == "http") & (p["port"] == "80")
        )
        port = F.when((p["port"] == "") | default, "").otherwise(F.concat(F.lit(":"), p["port"]))
        tail = [let(let(_path(p), remove_dot_segments), percent_encode)]
        if keep_query:
            tail.append(percent_encode(p["query"]))
        if keep_fragment:
            tail.append(percent_encode(p["fragment"]))
        whole = F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], port, *tail)
        return F.when(_absolute(p), whole)

    return let(parts(url), build)


def product_url(url: Column) -> Column:
    """No query, no fragment."""
    return canonical(url, keep_query=False, keep_fragment=False)


def page_url(url: Column) -> Column:
    """The query stays, it carries the page number."""
    return canonical(url, keep_fragment=False)


def resolve(href: Column, base: Column) -> Column:
    """An href as seen from ``base``, canonical; null when it cannot be resolved."""

    def join(x: Column) -> Column:
        ref, p = x["ref"], x["base"]
        port = F.when(p["port"] == "", "").otherwise(F.concat(F.lit(":"), p["port"]))
        origin = F.concat(p["scheme"], F.lit("://"), p["user"], p["host"], port)
        folder = F.regexp_replace(_path(p), r"[^/]*$", "")
        return (
            F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(p["scheme"], F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, ref))
            .when(ref == "", F.concat(origin, _path(p), p["query"]))
            .when(ref.startswith("?"), F.concat(origin, _path(p), ref))
            .when(ref.startswith("#"), F.concat(origin, _path(p), p["query"], ref))
            .otherwise(F.concat(origin, folder, ref))
        )

    both = F.struct(text.strip(href).alias("ref"), parts(base).alias("base"))
    return canonical(let(both, join))


def slug(url: Column) -> Column:
    """The last non-blank path segment of an absolute URL."""

    def last(p: Column) -> Column:
        segments = F.filter(F.split(let(_path(p), percent_encode), "/"), lambda s: s != "")
        return F.when(_absolute(p), F.try_element_at(segments, F.lit(-1)))

    return let(parts(url), last)


def legacy_slug(url: Column) -> Column:
    """P20."""
    bare = F.regexp_replace(F.substring_index(F.trim(url), "?", 1), r"^/+|/+$", "")
    last = F.regexp_replace(bare, r"^.*/", "")
    return F.when(last != "", last)


def on_site(url: Column, site_host: str | Column) -> Column:
    """Https and the configured host."""
    wanted = site_host if isinstance(site_host, Column) else F.lit(site_host)
    return let(
        parts(url),
        lambda p: F.coalesce((p["scheme"] == "https") & (p["host"] == F.lower(wanted)), F.lit(False)),
    )


def looks_like_product(url: Column, category_url: Column) -> Column:
    """P25: one path segment, not the category itself, no reserved prefix."""

    def judge(x: Column) -> Column:
        own, bare = x["own"], x["bare"]
        reserved = F.lit(False)
        for prefix in S.PRODUCT_PATH_DENY_PREFIXES:
            reserved = reserved | bare.startswith(prefix)
        return (
            (text.strip(bare) != "") & (own != x["category"]) & ~bare.contains("/") & ~reserved
        )

    def paths(x: Column) -> Column:
        own = F.lower(_path(x["own"]))
        return F.struct(
            own.alias("own"), F.btrim(own, F.lit("/")).alias("bare"),
            F.lower(_path(x["category"])).alias("category"),
        )

    both = F.struct(parts(url).alias("own"), parts(category_url).alias("category"))
    return let(let(both, paths), judge)


def idempotency_key(run_id: Column, url: Column) -> Column:
    """P26."""
    return F.sha2(F.concat(run_id.cast("string"), F.lit(":"), text.strip(url)), 256)


def contains_any(url: Column, words: list[str]) -> Column:
    """Case-insensitive: does the URL contain one of a configured list of substrings?"""
    lowered = F.lower(url)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found
