import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.llm import url_lists

CAPTURES = "page_id bigint, url string, fetched_at timestamp_ntz"
ENTRIES = "list_name string, kind string, value string, action string, listed_at timestamp_ntz"
DAY = datetime(2024, 1, 1)


def brute(captures, entries):
    """Decision and number of active entries for every capture, entry by entry."""
    log = {}
    for name, kind, value, action, at in entries:
        if value is not None and at is not None and action in ("block", "allow", "remove"):
            rank = ("allow", "block", "remove").index(action)
            log.setdefault((name, kind, value), {}).setdefault(at, []).append((rank, action))
    out = {}
    for page, url, at in captures:
        host = url.split("//")[1].split("/")[0].split(":")[0].lower() if url else None
        plain = host and host + "/" + url.split("//")[1].partition("/")[2].split("?")[0].split("#")[0]
        active = []
        for (name, kind, value), by in log.items():
            times = [t for t in by if at is not None and t <= at]
            meets = host and (kind == "url" and value == plain or kind == "host" and value == host or kind == "domain" and (host == value or host.endswith("." + value)))
            if times and meets:
                action = max(by[max(times)])[1]
                if action != "remove":
                    active.append(({"url": 1001, "host": 1000}.get(kind, value.count(".") + 1), action == "block", max(times), name))
        out[page] = ("block" if active and max(active)[1] else "allow", len(active))
    return out


def test_decisions_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "xa.com"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/p?q=1", ":80/p#f")]
    day = lambda n: DAY + timedelta(days=n)
    captures = [(i, rng.choice(urls), day(rng.randrange(30))) for i in range(200)] + [(900, None, day(1)), (901, urls[0], None), (902, "not a url", day(3))]
    entries = [("l" + str(rng.randrange(2)), k, rng.choice([h + "/p" for h in hosts] if k == "url" else hosts + ["com"]), rng.choice(["block", "allow", "remove"]), day(rng.randrange(30))) for k in ("url", "host", "domain") for _ in range(40)]
    entries += [("l", "host", None, "block", DAY), ("l", "host", "a.com", "block", None), ("l", "host", "a.com", "nonsense", DAY)]
    plain = [(p, u if u != "not a url" else None, t) for p, u, t in captures]
    df, log = spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    for bound in (url_lists.MAX_BROADCAST_INTERVALS, 0):
        monkeypatch.setattr(url_lists, "MAX_BROADCAST_INTERVALS", bound)
        got = {r["page_id"]: (r["decision"], r["n_active"]) for r in url_lists.filter_captures(df, log).collect()}
        assert got == brute(plain, entries)


def test_interval_ends_when_the_entry_is_removed(spark):
    log = spark.createDataFrame([("l", "host", "a.com", "block", DAY), ("l", "host", "a.com", "remove", DAY + timedelta(days=5))], ENTRIES)
    df = spark.createDataFrame([(n, "https://A.com./x", DAY + timedelta(days=n)) for n in (-1, 0, 4, 5, 6)], CAPTURES)
    got = {r["page_id"]: r["decision"] for r in url_lists.filter_captures(df, log).collect()}
    assert got == {-1: "allow", 0: "block", 4: "block", 5: "allow", 6: "allow"}


def test_repeats_extra_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.com/", DAY)] * 3, CAPTURES).withColumn("kind", F.lit("x")).withColumn("action", F.lit("y"))
    log = spark.createDataFrame([("l", "host", "a.com", "block", DAY)], ENTRIES).withColumn("url", F.lit("z"))
    assert [r["decision"] for r in url_lists.filter_captures(df, log).collect()] == ["block"] * 3
    assert [r["decision"] for r in url_lists.filter_captures(df, log.where("false")).collect()] == ["allow"] * 3
    assert url_lists.filter_captures(df.where("false"), log).count() == 0
