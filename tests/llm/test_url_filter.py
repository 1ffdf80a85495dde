import datetime as dt
import re

import pytest

from framelake.llm import graph, url_filter
from framelake.llm.url_filter import filter_urls

D = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
ENTRIES = [
    ("a", "host", "x.example.com", "block", D(10)),
    ("a", "host", "x.example.com", "block", D(10)),
    ("a", "host", "x.example.com", "remove", D(20)),
    ("a", "host", "x.example.com", "block", D(30)),
    ("b", "domain", "Example.com", "block", D(5)),
    ("b", "domain", "example.com", "remove", D(40)),
    ("c", "prefix", "x.example.com/ok", "allow", D(12)),
    ("c", "prefix", "x.example.com/ok/not", "block", D(12)),
    ("d", "host", "y.example.com", "allow", D(0)),
    ("e", "host", "y.example.com", "block", D(0)),
    ("f", "host", "z.test", "block", D(3)),
    ("f", "host", "z.test", "allow", D(3)),
    ("g", "host", None, "block", D(3)),
    ("g", "host", "n.test", "block", None),
]
URLS = ["http://x.example.com/a", "https://user:p@X.example.com:8080/ok/page?q=/ok/not", "http://x.example.com/ok/not/1#top", "http://w.example.com", "http://y.example.com/", "ftp://z.test/q", "http://n.test/", "http://notexample.com/", "no url", "", None]


def brute_force(url, at):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", url or "")
    if not m or not m[1] or at is None:
        return "keep", None
    host = m[1].lower()
    labels, parts = host.split("."), [p.lower() for p in m[2].split("/") if p]
    keys = [("host", host), *[("domain", ".".join(labels[i:])) for i in range(len(labels))], *[("prefix", "/".join([host, *parts[: i + 1]])) for i in range(len(parts))]]
    best = None
    for scope, key in keys:
        for name in {e[0] for e in ENTRIES}:
            own = [e for e in ENTRIES if e[0] == name and e[1] == scope and (e[2] or "").lower() == key and e[4] and e[4] <= at]
            if not own:
                continue
            last = max(e[4] for e in own)
            action = max((e[3] for e in own if e[4] == last), key=["remove", "block", "allow"].index)
            if action != "remove":
                rank = (["domain", "host", "prefix"].index(scope), len(key), action == "allow", name)
                best = max(best or rank, rank)
                if best == rank:
                    found = action, key
    return found if best else ("keep", None)


@pytest.mark.parametrize("most", [url_filter.BROADCAST, 0])
def test_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "BROADCAST", most)
    monkeypatch.setattr(graph, "HEAVY", 3)
    rows = [(i, u, D(n) if n is not None else None, "clash") for i, u in enumerate(URLS) for n in (0, 4, 5, 11, 12, 20, 25, 35, 50, None)]
    captures = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, fetched_at timestamp, decision string")
    entries = spark.createDataFrame(ENTRIES, "list_name string, scope string, key string, action string, listed_at timestamp")
    got = filter_urls(captures, entries).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r["decision"], r["key"]) == brute_force(r["url"], r["fetched_at"]), r
        assert r["decision_in"] == "clash"
    assert {r["decision"] for r in got} == {"keep", "allow", "block"}


def test_no_rows(spark):
    captures = spark.createDataFrame([(1, "http://a.b/", D(1))], "page_id long, url string, fetched_at timestamp")
    entries = spark.createDataFrame([], "list_name string, scope string, key string, action string, listed_at timestamp")
    assert [r["decision"] for r in filter_urls(captures, entries).collect()] == ["keep"]
    assert filter_urls(captures.limit(0), entries).collect() == []


def test_clashing_names(spark):
    names = "page_id long, url string, fetched_at timestamp, u string, at string, best string, key string, key_in string, sk string, s string"
    captures = spark.createDataFrame([(1, URLS[0], D(11), "1", "2", "3", "4", "5", "6", "7")], names)
    entries = spark.createDataFrame(ENTRIES, "list_name string, scope string, key string, action string, listed_at timestamp")
    got = filter_urls(captures, entries)
    assert got.columns == ["page_id", "url", "fetched_at", "u", "at", "best", "key_in_", "key_in", "sk", "s", "decision", "list_name", "scope", "key", "valid_from"]
    assert [tuple(r)[3:12] for r in got.collect()] == [("1", "2", "3", "4", "5", "6", "7", "block", "a")]
