"""A crawl kept in the store: killed anywhere it goes on, hosts are fetched side by side, files are written once."""

import time

import pytest
from pyspark.sql import functions as F

from clausebase.operators import crawl, scrape
from clausebase.sources import extractors, snapshots
from clausebase.sources.snapshots import Store, Transaction

ROOT = "http://h/view_section.jsp?lang=0&id=0,1"


class Killed(Exception):
    pass


def page(k):
    return f"http://h/view_section.jsp?lang=0&id={k}"


SITE = {
    ROOT: '<title>Root</title><a href="view_section.jsp?lang=0&amp;id=0,1,1">A</a><a href="view_section.jsp?lang=0&amp;id=0,1,2">B</a><a href="view_section.jsp?lang=0&amp;id=0,1">self</a><a href="view_section.jsp?lang=0&amp;id=0,2">out</a><!-- <a href="view_section.jsp?lang=0&amp;id=0,1,9">gone</a> -->',
    page("0,1,1"): '<a href="docs/one.pdf">One</a><a href="docs/two.doc"></a><a href="view_section.jsp?lang=0&amp;id=0,1,3">C</a>',
    page("0,1,2"): '<a href="docs/one.pdf">again</a><a href="view_section.jsp?lang=0&amp;id=0,1,3">late</a><a href="view_section.jsp?lang=0&amp;id=0,1,4">dead</a>',
    page("0,1,3"): '<a href="docs/three.pdf">Three</a><a href="docs/two.doc">late</a>',
}


def answers(spark, site=SITE):
    known = spark.createDataFrame([(u, bytearray(h.encode())) for u, h in site.items()], "url string, content binary")
    return lambda asked: asked.join(known, "url", "left").select("url", "content", F.lit(200).alias("http_status"))


def outcome(state):
    nodes = sorted((r.id, r.url, r.crumb, r.level, r.node_ord, r.fetched, r.page_ok) for r in scrape.menu_of(state).collect())
    docs = sorted((r.source_url, r.title, r.section_path, r.menu_id, r.level, r.node_ord, r.link_ord) for r in state.read("found_documents", scrape.FOUND).collect())
    return nodes, docs


def test_crawl_equals_that_of_tables(spark, tmp_path):
    state = scrape.crawl_store(Store(spark, str(tmp_path)), ROOT, answers(spark))
    nodes, docs = outcome(state)
    assert [(n[0], n[2], n[6]) for n in nodes] == [("0,1", "Root", True), ("0,1,1", "Root > A", True), ("0,1,2", "Root > B", True), ("0,1,3", "Root > A > C", True), ("0,1,4", "Root > B > dead", False)]
    table = spark.createDataFrame(list(SITE.items()), "url string, html string")
    menu, found = crawl.crawl_pages(table, ROOT)
    assert sorted((r.id, r.url, r.crumb, r.level, r.node_ord) for r in menu.collect()) == [n[:5] for n in nodes]
    assert sorted((r.source_url, r.title, r.section_path, r.menu_id) for r in found.collect()) == [d[:4] for d in docs]


def test_killed_crawl_goes_on(spark, tmp_path, monkeypatch):
    """Killed at each of its writes in turn, one page for each commit: no page is fetched after its commit, and the end is that of an unbroken crawl."""
    whole = outcome(scrape.crawl_store(Store(spark, str(tmp_path / "whole")), ROOT, answers(spark)))
    real_write, real_put = Transaction._write, snapshots.Files.put_new
    fetched = []
    base = answers(spark)

    def fetch(asked):
        fetched.extend(r.url for r in asked.collect())
        return base(asked)

    done, k = False, 2
    while not done:
        left = k
        k += 3

        def count():
            nonlocal left
            left -= 1
            if left < 0:
                raise Killed

        def write(self, *a):
            out = real_write(self, *a)
            count()
            return out

        monkeypatch.setattr(Transaction, "_write", write)
        monkeypatch.setattr(snapshots.Files, "put_new", lambda self, *a: (count(), real_put(self, *a)))
        before = scrape.menu_of(Store(spark, str(tmp_path / "cut")).snapshot())
        visited = {r.url for r in before.where("fetched").collect()}
        fetched.clear()
        try:
            state = scrape.crawl_store(Store(spark, str(tmp_path / "cut")), ROOT, fetch, batch=1)
            done = True
        except Killed:
            pass
        assert not visited & set(fetched)
    assert k > 8 and outcome(state) == whole


def test_most_pages_ends_the_call_only(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    state = scrape.crawl_store(store, ROOT, answers(spark), most_pages=2)
    assert scrape.menu_of(state).where("fetched").count() == 2
    assert scrape.crawl_store(store, ROOT, answers(spark), most_pages=0).version == state.version
    assert scrape.menu_of(scrape.crawl_store(store, ROOT, answers(spark))).where("fetched").count() == 5


def test_downloads(spark, tmp_path):
    store, docs = Store(spark, str(tmp_path / "store")), str(tmp_path / "docs")
    scrape.crawl_store(store, ROOT, answers(spark))
    files = {"http://h/docs/one.pdf": "1", "http://h/docs/three.pdf": "3"}
    got = {r.source_url.rpartition("/")[2]: r for r in scrape.found_of(scrape.download_store(store, docs, answers(spark, files), batch=2), docs).collect()}
    assert {n: (r.download_ok, r.error) for n, r in got.items()} == {"one.pdf": (True, None), "three.pdf": (True, None), "two.doc": (False, "download failed")}
    assert open(got["one.pdf"].local_path).read() == "1" and got["one.pdf"].local_path.startswith(f"{docs}/Root/A/One_")

    def second(asked):
        assert [r.url for r in asked.collect()] == ["http://h/docs/two.doc"]
        return answers(spark, {"http://h/docs/two.doc": "2"})(asked)

    state = scrape.download_store(store, docs, second)
    assert scrape.found_of(state, docs).where("download_ok").count() == 3
    # an index without outcomes finds the files that are there and fetches none
    change = store.begin()
    lost = state.read("found_documents", scrape.FOUND)
    change.overwrite("found_documents", lost.withColumns({"download_ok": F.lit(None).cast("boolean"), "sha1": F.lit(None).cast("string")}), scrape.BY_URL)
    change.commit()
    again = scrape.found_of(scrape.download_store(store, docs, answers(spark, {})), docs)
    assert sorted(r.sha1 for r in again.collect()) == sorted(r.sha1 for r in scrape.found_of(state, docs).collect())


def test_delay_holds_within_a_host_and_hosts_take_turns(spark, tmp_path):
    log = str(tmp_path / "log")

    def get(url):
        with open(log, "a") as file:
            file.write(f"{time.time()} {url}\n")
        if url.endswith("flaky") and sum(line.endswith("flaky\n") for line in open(log)) < 2:
            raise OSError(url)
        return None if url.endswith("dead") else (url.encode(), 200)

    asked = [(f"http://{host}/{k}",) for host in "abcd" for k in range(3)] + [("http://A/flaky",), ("https://b/dead",), (None,)]
    began = time.time()
    got = extractors.fetch(spark.createDataFrame(asked, "url string").where("url is not null"), get, delay=0.3, tries=2, backoff=0.1, tasks=2).collect()
    assert {r.url: r.http_status for r in got} == {u: (None if u.endswith("dead") else 200) for (u,) in asked if u}
    times = {}
    for line in open(log):
        at, url = line.split()
        times.setdefault(url.split("/")[2].lower(), []).append(float(at))
    assert sum(map(len, times.values())) == 16
    for own in times.values():
        assert all(b - a >= 0.29 for a, b in zip(own, own[1:]))
    assert max(times["a"][0], times["b"][0], times["c"][0], times["d"][0]) < min(own[-1] for own in times.values())
    assert time.time() - began < 60


@pytest.mark.parametrize("url, known", [("http://h/none", True), ("http://h/none", False)])
def test_dead_root(spark, tmp_path, url, known):
    state = scrape.crawl_store(Store(spark, str(tmp_path)), url, answers(spark, {url: ""} if known else {}))
    assert outcome(state) == ([("root", url, "section-root", 0, "", True, known)], [])
