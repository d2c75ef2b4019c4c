"""URL filters: the list against plain loops, mined rules against all combinations of tokens."""

import itertools
import math
import re

import pytest

from binloom.llm import urls

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme", "://", "http://", "HTTP://Www.EXAMPLE.com/en/1", "https://www.example.com/en", "https://www.example.com/en/x?a=1&b=2#c", "https://x.example.com/EN/1", "https://example.com",
    "https://example.com?x=/en/", "https://notexample.com/en/1", "http://a.net/es/1", "http://net/fr/", "http://a.net.org/es/1", "http://ÄÖ.net/es/é", "http://a.net/es\n/x", "a://b://c.com/", "http://com./x", "http://..net/fr/..",
    "http://long.org/" + "a/" * 3000, "http://u@h.com:80/x", "http://com/", "http://org/?q", "http://b.org/es/7", "http://b.org/es/8",
]
LIST = [*urls.OP12_RULES, ("org", "/es/7", "allow"), ("b.org", "/es/7", "block"), ("b.org", "/es/7", "allow")]
SETTINGS = urls.Mining(support=0.02, confidence=0.7)


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    after = url.split("://", 1)[1]
    host = re.match(r"(?s)[^/?#]*", after)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"(?s)[^?#]*", after[len(host) :])[0]


def plain_rule(url, rules):
    host, path = plain_parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


def plain_tokens(url):
    host, path = plain_parts(url)
    out = {"host " + x for x in host.split(".") if x} | {"path " + re.sub("[0-9]+", "0", x) for x in re.findall(r"[^/._\-]+", path)}
    query = re.match(r"(?s)[^?#]*\?([^#]*)", url or "") if "://" in (url or "") else None
    return out | {"query " + x for x in re.findall(r"(?:^|&)([^=&]+)", query[1])} if query else out


def plain_verdicts(every, taught, settings):
    """Verdict and reason of each url, from all combinations of the tokens of the taught ones (url -> verdict)."""
    have = {u: plain_tokens(u) for u in taught}
    least = settings.support * len(taught)
    where = {}
    for u, ts in have.items():
        for t in ts:
            where.setdefault(t, set()).add(u)
    names = {}
    for t, us in sorted(where.items()):
        if len(us) >= least:
            names.setdefault(frozenset(us), t)
    keep = set(names.values())
    counts = {}
    for u, ts in have.items():
        ts = sorted(ts & keep)
        for n in range(1, len(ts) + 1):
            for c in itertools.combinations(ts, n):
                counts.setdefault(c, []).append(taught[u])
    rules = []
    for c, vs in counts.items():
        for v in set(vs):
            n = vs.count(v)
            if n >= math.ceil(least) and n / len(vs) >= settings.confidence:
                rules.append((n / len(vs), n / len(taught), -len(c), v == "block", ", ".join(c), v, set(c)))
    out = {}
    for u in every:
        hits = [r[:6] for r in rules if r[6] <= plain_tokens(u)]
        out[u] = max(hits)[4:][::-1] if hits else ("allow", None)
    return out


def plain(rows, rules, settings, taught=None):
    listed = {u: plain_rule(u, rules) for _, u in rows}
    taught = taught if taught is not None else {u or "": v for u, (_, v) in listed.items() if v}
    mined = plain_verdicts({u or "" for u, (_, v) in listed.items() if not v}, taught, settings)
    out = []
    for i, u in rows:
        rule, verdict = listed[u]
        out.append((i, u, *plain_parts(u), rule, *((verdict, None) if verdict else mined[u or ""])))
    return out


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, u, "clash", 1, "k") for i, u in enumerate(URLS)]
    rows += [rows[5], rows[12], rows[12], (None, URLS[13], None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, have int, rule string").repartition(3)


def test_odd_urls_equal_a_plain_version(odd):
    rows = [tuple(r) for r in odd.select("page_id", "url").collect()]
    assert sorted_rows(urls.judge_urls(odd, LIST, SETTINGS).collect()) == sorted_rows(plain(rows, LIST, SETTINGS))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_a_plain_version(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()]
    want = plain(rows, urls.OP12_RULES, urls.Mining())
    got = urls.op12_association_url_filter(spark, sf)
    assert sorted_rows(got.collect()) == sorted_rows((i, *rest) for i, _, *rest in want)
    assert {r[4] for r in want} == {None, *(h + p for h, p, _ in urls.OP12_RULES)} - {"www.example.com/en/"} or {r[4] for r in want} >= {None, "com/"}


def test_given_labels_teach(odd, spark):
    taught = {f"http://{h}.site.org/{p}/{i}?x=1": "block" if h == "ads" or (p == "bet" and h != "m") else "allow" for h in ("ads", "www", "m") for p in ("bet", "news", "en") for i in range(4)}
    labels = spark.createDataFrame([*taught.items(), (None, "block"), ("http://z.org", None)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://ads.other.org/en/9"), (2, "http://www.site.org/bet/1"), (3, "http://m.site.org/bet/1"), (4, "http://m.site.org/bet/1")], "page_id long, url string")
    got = urls.judge_urls(pages, [], SETTINGS, labelled=labels).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert sorted_rows(got) == sorted_rows(plain([tuple(r) for r in pages.collect()], [], SETTINGS, taught))


def test_weaker_rules_go_and_verdicts_stay(spark):
    rows = [(f"u{i}", ["a", "b", "c"] if i % 2 else ["a", "b"], "block") for i in range(10)] + [(f"v{i}", ["b", "d"], "allow") for i in range(6)]
    rules = {(tuple(r["tokens"]), r["verdict"]) for r in urls.mine(spark.createDataFrame(rows, "url string, tokens array<string>, verdict string"), urls.Mining(0.1, 0.6)).collect()}
    assert rules == {(("a",), "block"), (("b",), "block"), (("c",), "block"), (("d",), "allow")}


def test_a_shuffled_index_and_a_sample(odd, spark, monkeypatch):
    want = sorted_rows(urls.judge_urls(odd, LIST, SETTINGS).collect())
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    assert sorted_rows(urls.judge_urls(odd, LIST, SETTINGS).collect()) == want
    few = urls.judge_urls(odd, LIST, urls.Mining(0.02, 0.7, sample=4)).collect()
    assert [tuple(r)[:5] for r in sorted(few, key=repr)] == [t[:5] for t in sorted(want, key=lambda t: repr(t))] or len(few) == len(want)


def test_empty_tables_and_nothing_decided(odd):
    assert urls.judge_urls(odd.limit(0), LIST).isEmpty()
    got = urls.judge_urls(odd, []).collect()
    assert {(r["rule"], r["verdict"]) for r in got} == {(None, "allow")} and len(got) == odd.count()
