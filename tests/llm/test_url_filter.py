import datetime as dt

from plumbline.llm import url_filter
from plumbline.llm.url_filter import filter_captures, intervals

T = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
CHANGES = [
    ("bad.example", T(0), "add"), ("bad.example", T(100), "remove"), ("Bad.example.", T(200), "add"), ("bad.example", T(200), "remove"), ("sub.bad.example", T(50), "add"), ("sub.bad.example", T(60), "add"),
    ("sub.bad.example", T(70), "remove"), (None, T(0), "add"), ("x.example", None, "add"), ("y.example", T(0), "odd"), ("z.example", T(5), "remove"), ("late.example", T(900), "add"), ("bad.example", T(0), "add"),
]
URLS = ["http://bad.example/x", "https://user@SUB.bad.example:80/", "http://notbad.example/", "http://sub.bad.example.", None, "", "no url", "http:///path", "http://z.example", "http://late.example", "http://y.example/", "http://a.b.c.sub.bad.example/?q=http://x.example/" + "p" * 20000]


def slow(url_host, at):
    if url_host is None or at is None:
        return []
    out = []
    for key in {(k or "").lower().rstrip(".") for k, t, a in CHANGES if k}:
        if url_host == key or url_host.endswith("." + key):
            own = [(t, a == "add") for k, t, a in CHANGES if k and t and a in ("add", "remove") and k.lower().rstrip(".") == key and t <= at]
            if own and max(own)[1]:
                out.append(key)
    return out


def test_against_every_change(spark):
    rows = [(i * 1000 + d, u, T(d) if d < 950 else None, "e") for i, u in enumerate(URLS) for d in (0, 49, 50, 65, 70, 99, 100, 150, 200, 899, 901, 951)]
    rows += rows[:3]
    got = filter_captures(spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp, entry string"), spark.createDataFrame([(*c, "h") for c in CHANGES], "key string, at timestamp, action string, host string")).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    hosts = ["bad.example", "sub.bad.example", "notbad.example", "sub.bad.example", None, None, None, None, "z.example", "late.example", "y.example", "a.b.c.sub.bad.example"]
    for r in got:
        want = slow(hosts[r.page_id // 1000], r.fetched)
        assert (r.host, r.blocked, r.n_entries, r.entry) == (hosts[r.page_id // 1000], bool(want), len(want), max(want, key=len, default=None)), r


def test_intervals(spark):
    got = sorted(tuple(r) for r in intervals(spark.createDataFrame(CHANGES, "key string, at timestamp, action string")).collect() if r.key.endswith("bad.example"))
    assert got == [("bad.example", T(0), T(100)), ("bad.example", T(200), None), ("sub.bad.example", T(50), T(70))]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", T(1))], "page_id bigint, url string, fetched timestamp")
    changes = spark.createDataFrame(CHANGES, "key string, at timestamp, action string")
    assert filter_captures(pages.limit(0), changes).collect() == []
    assert [r.blocked for r in filter_captures(pages, changes.limit(0)).collect()] == [False]
    assert [r.blocked for r in filter_captures(pages.selectExpr("page_id", "url", "cast(null as timestamp) fetched"), changes).collect()] == [False]


def test_one_key_for_most_captures(spark):
    changes = [("com", T(10), "add"), ("com", T(90), "remove"), ("com", T(120), "add"), ("h3.com", T(40), "add"), ("h3.com", T(50), "remove"), ("org", T(500), "add")]
    rows = [(i, f"http://{'www' if i % 2 else f'h{i % 9}'}.{'com' if i % 5 else 'net'}/", T(i % 200)) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, fetched timestamp").repartition(3)
    listed = spark.createDataFrame(changes, "key string, at timestamp, action string")
    pairs = df.select(url_filter.host_of(df.url).alias("host"), "fetched").distinct()
    found = [{(r.host, r.fetched, r.entry, r.since, r.n_entries) for r in url_filter.active_entries(pairs, intervals(listed), few).collect()} for few in (0, 10**6)]
    assert found[0] == found[1]
    for r in filter_captures(df, listed).collect():
        day = (r.fetched - T(0)).days
        com = r.host.endswith(".com") and (10 <= day < 90 or day >= 120)
        h3 = r.host == "h3.com" and 40 <= day < 50
        assert (r.blocked, r.n_entries, r.entry) == (com or h3, com + h3, "h3.com" if h3 else "com" if com else None)
