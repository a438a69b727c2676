import random

from pricetrail.llm import url_rules


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({i: i + 32 for i in range(65, 91)})
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [
        (len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else url_rules.DEFAULT


def test_against_brute_force(spark):
    rnd = random.Random(10)
    labels = ["a", "b", "com", "org", "example", "X", "é", ""]
    urls = [
        "".join([rnd.choice(["http://", "https://", "", "x://y://"]), ".".join(rnd.choice(labels) for _ in range(rnd.randrange(1, 5))),
                 rnd.choice(["", "/", "/es/", "/en/1", "/fr/a/b", "?q=/es/", "#x", "/é?x#y", "/en/12?a://b"])])
        for _ in range(600)
    ]
    urls += [None, "", "://", "http://", "http://ORG", "http://org/", "http://example.org/es/x", "http://badexample.org/es/x", "a\nb://org/\nx?y"]
    urls += ["http://hot.example.com/fr/1"] * 300
    rules = [(".".join(rnd.choice(labels[:5]) for _ in range(rnd.randrange(1, 4))), rnd.choice(["/", "", "/es/", "/en/1", "/fr/a", "/x"]), v) for v in ["allow", "block"] * 25]
    unique = {}
    for h, p, v in [*url_rules.RULES, *rules]:
        unique[h, p] = max(v, unique.get((h, p), v))
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, part int")
    given = spark.createDataFrame([*url_rules.RULES, *rules], "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_rules.filter_urls(pages, given).collect()}
    wanted = {i: brute(u, [(h, p, v) for (h, p), v in unique.items()]) for i, u in enumerate(urls)}
    assert len(got) == len(urls)
    assert {i: (got[i], wanted[i]) for i in got if got[i] != wanted[i]} == {}


def test_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x"), (None, None), (1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted(r["verdict"] for r in url_rules.filter_urls(pages, none).collect()) == ["allow"] * 3
    assert url_rules.filter_urls(pages.limit(0), none).collect() == []
