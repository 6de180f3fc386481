"""URL templates: chains of any length, pools that labelled branches vouch for, and rules against a plain version."""

import os
import random

from codesift.llm import url_filter
from codesift.llm.queries import URL_RULES, op3_url_filter


def test_a_long_chain_is_one_step(spark, monkeypatch):
    folders = []
    made = url_filter.new_table_path

    def noted(session, name):
        folders.append(made(session, name))
        return folders[-1]

    monkeypatch.setattr(url_filter, "new_table_path", noted)
    deep = "/".join(f"d{k}" for k in range(400))
    urls = [f"http://trap.org/{deep}/{end}" for end in ("a/x", "a/y", "b", "b/c", "")] + ["http://trap.org/z", f"http://trap.org/{deep}"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labelled = spark.createDataFrame([(urls[0], 1)] * 40 + [(urls[5], 0)], "url string, bad int")
    found = {row.page_id: row for row in url_filter.judge_urls(pages, (), labelled=labelled).collect()}
    assert [found[k].verdict for k in range(7)] == ["block"] + ["allow"] * 6
    assert found[0].template == "/" + urls[0].removeprefix("http://trap.org/")
    assert len({found[k].template for k in range(7)}) == 7
    levels = [folder for folder in folders if "url-levels" in folder]
    assert len(levels) == 1 and len(os.listdir(levels[0].removeprefix("file:"))) <= 6


def test_pools_take_in_branches_without_labels(spark):
    def urls(section):
        return [f"http://shop.org/{section}/{n}/view.html" for n in range(10)]

    sections = [f"part{k}" for k in range(8)]
    bad = [(url, 1) for section in sections[:6] for url in urls(section)]
    good = [(f"http://shop.org/help{k}/{n}-x/faq", 0) for k in range(6) for n in range(10)]
    free = [url for section in sections for url in urls(section)]
    free += [f"http://shop.org/help{k}/{n}-x/faq" for k in range(8) for n in range(3)] + ["http://shop.org/about", "http://shop.org/"]
    # Another host, with too few labelled branches to vouch for the others.
    few = [(f"http://few.org/s{k}/{n}", 1) for k in range(2) for n in range(30)]
    free += [f"http://few.org/s{k}/{n}" for k in range(4) for n in range(3)]
    pages = spark.createDataFrame(list(enumerate(free)), "page_id long, url string")
    labelled = spark.createDataFrame(bad + good + few, "url string, bad int")
    found = {free[row.page_id]: row for row in url_filter.judge_urls(pages, (), labelled=labelled).collect()}
    for url, row in found.items():
        section = url.split("/")[3]
        assert (row.verdict == "block") == (section.startswith("part") or ("few.org" in url and section in ("s0", "s1"))), url
    assert found[urls("part7")[0]].purity > 0.9 and found["http://shop.org/about"].purity is None


def test_rules_against_a_plain_version(spark):
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "notexample.com", "a.net", "net", "x.org", "com", ""]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/es/1?q=/fr/", "/fr/#", "/es", "/fr/a.html"]
    urls = [None, "no host", "://", "http:/x.com/en/", "a://b://c.net/es/"]
    urls += [rng.choice(["http://", "https://", "x://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(200)]

    def plain(url):
        if url is None or "://" not in url:
            return "", "", None, None
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        return host, path, best and best.name, best and best.verdict

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = {row.page_id: row for row in url_filter.judge_urls(pages, URL_RULES).collect()}
    for k, url in enumerate(urls):
        host, path, rule, verdict = plain(url)
        row = found[k]
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert verdict is None or row.verdict == verdict
    assert op3_url_filter(spark, "/root/testdata/sf0.001").filter("verdict IS NULL").count() == 0
