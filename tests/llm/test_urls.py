import duckdb
import pytest
from pyspark.sql import functions as F

from blockweave.llm import urls

URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/7x?q#f", "https://example.com/en/8", "http://a.b.example.com/en/7", "http://notexample.com/en/7", "http://com/en/",
    "http://example.net/de/81", "http://example.net/de/7", "http://x.example.org/es/", "http://x.example.org/es", "http://x.org?/es/", "http://x.org#a/es/", "http://x.org/en/spam-farm", "http://x.org/en/spammer",
    "http://x.org/cheap/free", "http://x.org/cheap/cheap", "http://x.org/freedom-win", "http://x.org/Casino", "http://x.org/a?b=free&win", "http://É.org/ü/free_win", "http://a://b.com/en/", "http://x.com:80/en/1",
]


def by_hand(url):
    """Every rule and term in turn, without tables or automaton."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i, c in enumerate(rest) if c in "/?#"] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([i for i, c in enumerate(rest) if c in "?#"] or [len(rest)])]
    fit = [(h + "/" + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        return (host, path, *max(fit, key=lambda r: len(r[0])))
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    word = lambda c: c in "abcdefghijklmnopqrstuvwxyz0123456789"
    hit = {t for t in urls.VOCABULARY for i in range(len(low)) if low.startswith(t, i) and not (i and word(low[i - 1])) and not (i + len(t) < len(low) and word(low[i + len(t)]))}
    bad = any(urls.VOCABULARY[t] == 2 for t in hit) or sum(urls.VOCABULARY[t] == 1 for t in hit) >= 2
    return host, path, None, "block" if bad else "allow"


def test_against_every_rule_and_term(spark):
    rows = list(enumerate(URLS)) + [(None, "http://x.org/free/win"), (3, URLS[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = [tuple(r)[:5] for r in urls.judge_urls(df).collect()]
    assert sorted(got, key=repr) == sorted(((i, *by_hand(u)) for i, u in rows), key=repr)
    duckdb.sql("create or replace temp table pages (page_id bigint, url varchar)")
    duckdb.executemany("insert into pages values (?, ?)", rows)
    assert sorted((r[:5] for r in duckdb.sql(urls.sql()).fetchall()), key=repr) == sorted(got, key=repr)


def test_empty_table_and_vocabulary(spark):
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    df = spark.createDataFrame([(1, "http://x.org/spam")], "page_id long, url string")
    assert urls.judge_urls(df, (), {}).first().verdict == "allow"


@pytest.mark.parametrize("url", URLS)
def test_split(url):
    assert urls.split_url(url) == by_hand(url)[:2]


def test_the_rules_by_hand(spark):
    """Verdicts written out, so that a wrong rule can't hide behind the table that SQL and code share."""
    want = [
        ("http://com/en/x", "com/en/", "block"), ("http://a.com/en/", "com/en/", "block"), ("http://example.com/en/71", "example.com/en/7", "allow"), ("http://w.example.com/en/7", "example.com/en/7", "allow"),
        ("http://example.com/en/8", "com/en/", "block"), ("http://a.net/de/casino", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"), ("http://example.net/de/8", "example.net/de/8", "block"),
        ("http://w.example.net/de/81", "example.net/de/8", "block"), ("http://a.org/es/free", "org/es/", "block"), ("http://a.org/en/free", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(want)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in sorted(urls.judge_urls(df).collect())] == [w[1:] for w in want]
