import datetime

from pyspark.sql import functions as F

from merchantry.llm import url_filter

ENTRY = "list string, action string, kind string, pattern string, listed boolean, at timestamp"


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def entries(spark, *rows):
    return spark.createDataFrame([(*row[:5], day(row[5]) if row[5] is not None else None) for row in rows], ENTRY)


def judge(spark, listed, captures):
    df = spark.createDataFrame([(i, url, None if at is None else day(at)) for i, (url, at) in enumerate(captures)], "page_id long, url string, fetched_at timestamp")
    out = url_filter.judged(df.selectExpr("*", "1 AS kind", "2 AS host"), url_filter.validity(listed)).collect()
    return {r["page_id"]: (r["n_active"], r["lists"], r["allowed"], r["blocked"]) for r in out}


def test_entries_hold_from_their_day_to_the_next_change(spark):
    listed = entries(
        spark, ("l", "block", "host", "a.com", True, 10), ("l", "block", "host", "a.com", False, 20), ("l", "block", "host", "a.com", True, 30))
    got = judge(spark, listed, [("http://a.com/", n) for n in (9, 10, 19, 20, 29, 30, 500)])
    assert [got[i][3] for i in range(7)] == [False, True, True, False, False, True, True]


def test_validity_merges_repeats_and_settles_ties(spark):
    listed = entries(
        spark, ("l", "block", "host", "a.com", True, 1), ("l", "block", "host", "a.com", True, 1), ("l", "block", "host", "a.com", True, 5),
        ("l", "allow", "host", "a.com", True, 8), ("l", "block", "host", "a.com", True, 8), ("l", "block", "host", "a.com", False, 9),
        ("l", "block", "host", "a.com", True, 9), ("l", "block", None, "a.com", True, 9), ("l", "block", "host", "b.com", False, 3),
    )
    out = sorted((r["action"], r["valid_from"], r["valid_to"]) for r in url_filter.validity(listed).collect())
    assert out == [("allow", day(8), day(9)), ("block", day(1), day(8))]


def test_more_special_kinds_win(spark):
    listed = entries(
        spark, ("d", "block", "domain", "example.com", True, 0), ("h", "allow", "host", "good.example.com", True, 0),
        ("p", "block", "prefix", "good.example.com/bad/", True, 0), ("q", "allow", "prefix", "x.example.com/", True, 0),
        ("r", "block", "prefix", "x.example.com/", True, 0),
    )
    got = judge(spark, listed, [
        ("https://EXAMPLE.com", 1), ("http://user@good.example.com:80/a?x#y", 1), ("http://good.example.com./bad/page", 1),
        ("http://good.example.com/bad", 1), ("http://notexample.com/", 1), ("http://x.example.com/q", 1), ("http://deep.x.example.com/q", 1),
        (None, 1), ("/relative", 1), ("http://example.com", None), ("", 1),
    ])
    assert [got[i][3] for i in range(11)] == [True, False, True, False, False, True, True, False, False, False, False]
    assert got[2][:2] == (3, ["d", "h", "p"]) and got[1][2]


def test_brute_force_over_pages(spark):
    hosts = [f"h{i}.d{i % 3}.org" for i in range(7)]
    rows = []
    for i, pattern in enumerate(hosts + ["d0.org", "d1.org", "org"]):
        kind = "host" if pattern in hosts else "domain"
        for j in range(6):
            rows.append((f"l{i % 2}", "allow" if (i + j) % 3 == 0 else "block", kind, pattern, (i * j) % 4 != 1, (i * 7 + j * 13) % 60))
    captures = [(f"http://{hosts[i % 7]}/p/{i}", (i * 11) % 70) for i in range(300)]
    got = judge(spark, entries(spark, *rows), captures)
    rank = {"prefix": 3, "host": 2, "domain": 1}
    for i, (url, at) in enumerate(captures):
        host = url.split("/")[2]
        names = {("host", host)} | {("domain", host.split(".", k)[-1]) for k in range(2)}
        active = []
        for name, kind, pattern in {(r[0], r[2], r[3]) for r in rows if (r[2], r[3]) in names}:
            past = [r for r in rows if (r[0], r[2], r[3]) == (name, kind, pattern) and r[5] <= at]
            last = [r for r in past if r[5] == max(p[5] for p in past)]
            if last and all(r[4] for r in last):
                active.append((name, min(r[1] for r in last), kind))
        block = max([rank[k] for _, a, k in active if a == "block"], default=0)
        allow = max([rank[k] for _, a, k in active if a == "allow"], default=0)
        assert got[i] == (len(active), sorted({n for n, *_ in active}), bool(allow), bool(block) and block >= allow), i


def test_empty_sides(spark):
    none = entries(spark, ("l", "block", "host", "a.com", True, 1)).limit(0)
    assert judge(spark, none, [("http://a.com/", 1)]) == {0: (0, [], False, False)}
    listed = url_filter.validity(entries(spark, ("l", "block", "host", "a.com", True, 1)))
    captures = spark.createDataFrame([], "page_id long, url string, fetched_at timestamp")
    assert url_filter.judged(captures, listed).count() == 0


def test_patterns(spark):
    row = spark.range(1).select(url_filter.patterns(F.lit("a.b.org"), F.lit("/x/y/z.html")).alias("p")).first()["p"]
    assert [tuple(p) for p in row] == [
        ("host", "a.b.org"), ("domain", "a.b.org"), ("domain", "b.org"), ("prefix", "a.b.org/"), ("prefix", "a.b.org/x/"), ("prefix", "a.b.org/x/y/")]
