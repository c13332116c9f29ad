"""Operators against brute force and their properties, also with one dominating key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vacantia.functions.keywords import first_exclusion, title_passes
from vacantia.operators import queues
from vacantia.operators.containment import contained, titles_passing, with_first_exclusion
from vacantia.operators.dedup import first_wins_two_keys
from vacantia.operators.matching import lifecycle_tables, resolve_keys, with_lifecycle
from vacantia.operators.patches import COMPANY_DECISIONS, check_edits
from vacantia.operators.registry import NEW, PRIOR, merge_snapshot
from vacantia.operators.sequence import far_from_accepted, far_from_previous, status_changes
from vacantia.operators.skew import first_per_key, lookup, number_rows, time_chunk, top_per_key, with_previous
from vacantia.plans.rubric import Dimension, HardFilter, Rubric, hard_filter_result, live_score, score_rows, weighted_average

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def events(spark, seed, n=600, span=200_000, keys=4):
    """Random events; the first key has about half of them, and ties occur."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.5 else rnd.randrange(keys)
        rows.append((i, key, START + dt.timedelta(seconds=rnd.randrange(span)), rnd.choice("abc")))
    return rows, spark.createDataFrame(rows, "id long, k long, ts timestamp, status string")


def by_key(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("seed, gap, chunk", [(1, 30, 3600), (2, 900, 3600), (3, 3600, 3600), (4, 5, 86400), (5, 7, 7)])
def test_gap_from_accepted(spark, seed, gap, chunk):
    rows, df = events(spark, seed, span=20_000)
    want = set()
    for group in by_key(rows).values():
        last = None
        for r in group:
            if last is None or (r[2] - last).total_seconds() >= gap:
                want.add(r[0])
                last = r[2]
    got = {r.id for r in far_from_accepted(df, ["k"], "ts", "id", gap, chunk).collect()}
    assert got == want


def test_gap_cases(spark):
    # 3 s is suppressed, 4 s is not, and 3 + 3 s counts from the accepted one.
    at = [0, 3, 6, 20, 24]
    df = spark.createDataFrame([(i, 1, START + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "id long, k long, ts timestamp")
    assert sorted(r.id for r in far_from_accepted(df, ["k"], "ts", "id", 4).collect()) == [0, 2, 3, 4]
    assert sorted(r.id for r in far_from_previous(df, ["k"], "ts", "id", 4).collect()) == [0, 3, 4]


@pytest.mark.parametrize("chunk", [60, 3600, 86400])
def test_previous_value_equals_window(spark, chunk):
    _, df = events(spark, 9)
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = {(r.id, r.b) for r in df.select("id", F.lag("status").over(w).alias("b")).collect()}
    got = with_previous(df, ["k"], ["ts", "id"], {"b": F.col("status")}, time_chunk(F.col("ts"), chunk))
    assert {(r.id, r.b) for r in got.collect()} == want


def test_timeline_has_no_equal_neighbours(spark):
    rows, df = events(spark, 11)
    got = by_key([(r.id, r.k, r.ts, r.status) for r in status_changes(df, "k", "ts", "id", "status", chunk_seconds=600).collect()])
    for key, group in by_key(rows).items():
        kept = [s for i, s in enumerate(r[3] for r in group) if i == 0 or s != group[i - 1][3]]
        assert [r[3] for r in got[key]] == kept
    prior = spark.createDataFrame([(0, rows[0][3])], "k long, status string")
    first = by_key(rows)[0][0]
    changed = {r.id for r in status_changes(df, "k", "ts", "id", "status", prior).collect()}
    assert (first[0] in changed) == (first[3] != rows[0][3])


def test_numbers_are_consecutive(spark):
    rows, df = events(spark, 12)
    got = number_rows(df, ["ts", "id"], time_chunk(F.col("ts"), 3600), "n", 8).collect()
    ordered = [r.id for r in sorted(got, key=lambda r: r.n)]
    assert ordered == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(r.n for r in got) == list(range(8, 8 + len(rows)))


@pytest.mark.parametrize("seed", range(4))
def test_two_key_dedup_equals_one_pass(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"u{rnd.randrange(25)}", "c", f"r{0 if rnd.random() < 0.3 else rnd.randrange(25)}") for i in range(150)]
    seen_u, seen_r, want = set(), set(), set()
    for i, url, c, r in rows:
        if url not in seen_u and (c, r) not in seen_r:
            want.add(i)
            seen_u.add(url)
            seen_r.add((c, r))
    df = spark.createDataFrame(rows, "id int, u string, c string, r string")
    assert {r.id for r in first_wins_two_keys(df, "u", ["c", "r"], "id").collect()} == want


def test_two_key_chain(spark):
    df = spark.createDataFrame([(1, "u1", "k1"), (2, "u2", "k1"), (3, "u2", "k2")], "id int, u string, r string")
    assert sorted(r.id for r in first_wins_two_keys(df, "u", ["r"], "id").collect()) == [1, 3]


# ── skewed lookups ───────────────────────────────────────────────────


def test_lookup_splits_a_hot_key(spark):
    facts = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"))
    facts = facts.withColumn("pad", F.sha2(F.col("id").cast("string"), 512))
    table = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lookup(facts, table, "k")
        total = joined.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n").isNull()).alias("missing"), F.sum(F.when(F.col("k") == "hot", F.col("n"))).alias("s"), F.max(F.length("pad")))
        r = total.collect()[0]
        assert (r.rows, r.missing, r.s) == (200_000, 0, 66_667 * 66_667)
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lookup_keeps_rows_without_match(spark):
    facts = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None), (4, "a", 2)], "id int, k string, j int")
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, j int, v string")
    assert {r.id: r.v for r in lookup(facts, table, ["k", "j"]).collect()} == {1: "x", 2: None, 3: None, 4: None}


def test_first_and_top_cut_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    for out, size in ((first_per_key(df, ["k"], ["id"]), 7), (top_per_key(df, ["k"], ["id"], 3), 21)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan and plan.index("Partial") > 0
        assert out.count() == size


# ── merges ───────────────────────────────────────────────────────────

REG = "key string, grp string, title string, decision string, live boolean, first_seen date, last_seen date"
POLICY = {"grp": NEW, "title": NEW, "decision": PRIOR}


def merged(spark, prior, scan, day, groups=None):
    table = spark.createDataFrame(scan, "key string, grp string, title string")
    scanned = spark.createDataFrame([(g,) for g in groups], "grp string") if groups else None
    return merge_snapshot(prior, table, "key", "grp", POLICY, scanned, F.lit(day).cast("date"))


def rows_of(df):
    return {r.key: r for r in df.collect()}


def test_registry_over_three_scans(spark):
    empty = spark.createDataFrame([], REG)
    scan = [("1", "a", "t"), ("2", "a", "t"), ("3", "b", "t"), ("4", "c", "t")]
    first = merged(spark, empty, scan, "2024-01-01")
    assert all(r.live and str(r.first_seen) == "2024-01-01" for r in rows_of(first).values())
    decided = first.withColumn("decision", F.when(F.col("key") == "2", "shortlist"))
    # A partial scan of group a: 2 is gone, b and c were not looked at.
    second = rows_of(merged(spark, decided, [("1", "a", "new")], "2024-02-01"))
    assert [second[k].live for k in "1234"] == [True, False, True, True]
    assert second["2"].decision == "shortlist" and str(second["2"].last_seen) == "2024-01-01"
    assert second["1"].title == "new" and str(second["1"].first_seen) == "2024-01-01" and str(second["1"].last_seen) == "2024-02-01"
    # A full scan: 2 is back, c came back empty and therefore expires.
    before = merged(spark, decided, [("1", "a", "new")], "2024-02-01")
    third = rows_of(merged(spark, before, [("1", "a", "new"), ("2", "a", "t"), ("3", "b", "t")], "2024-03-01", ["a", "b", "c"]))
    assert [third[k].live for k in "1234"] == [True, True, True, False]
    assert third["2"].decision == "shortlist"


def test_same_scan_twice_moves_only_last_seen(spark):
    scan = [("1", "a", "t"), ("2", "b", "t")]
    once = merged(spark, spark.createDataFrame([], REG), scan, "2024-01-01")
    twice = merged(spark, once, scan, "2024-02-01")
    assert sorted(map(tuple, once.drop("last_seen").collect())) == sorted(map(tuple, twice.drop("last_seen").collect()))


# ── scores ───────────────────────────────────────────────────────────


def test_weighted_average_properties(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, None), (2.0, 4.0, 3.0), (None, 4.5, None)], "a double, b double, c double")
    cols = {c: F.col(c) for c in "abc"}

    def scores(weights):
        return [r[0] for r in df.select(weighted_average(cols, weights)).collect()]

    base = scores({"a": 50, "b": 30, "c": 20})
    assert base == [pytest.approx(150 / 70), None, pytest.approx(2.8), 4.5]
    assert scores({"a": 500, "b": 300, "c": 200}) == [None if x is None else pytest.approx(x) for x in base]


def test_rubric(spark):
    facets = spark.createDataFrame(
        [("senior", 1, ["Go", "PHP"], "us_only"), ("", 8, ["go", "x", "x", "y", "z", "q", "r"], None), ("manager", None, [], "global"), (None, None, None, None)],
        "seniority string, yoe_min int, languages array<string>, geo_eligibility string",
    )
    rubric = Rubric(
        (Dimension("level", 60, "level"), Dimension("languages", 40, "languages")),
        {"languages": {"love": ["Go"], "avoid": ["php"]}}, (HardFilter("geo_eligibility", ("US_only",)), HardFilter("languages", ("x",), is_array=True)),
    )
    rows = score_rows(facets, rubric, F.col).collect()
    assert [r.dim_scores["level"] for r in rows] == [5.0, 4.0, 1.0, None]
    assert [r.dim_scores["languages"] for r in rows] == [1.5, 3.0, None, None]
    assert [r.hard_excluded for r in rows] == [True, True, False, False]
    assert rows[2].computed_score == 1.0 and rows[3].computed_score is None
    for years, rung in ((2, 3.0), (3, 4.0), (5, 5.0), (8, 4.0)):
        one = facets.limit(1).withColumns({"seniority": F.lit("unclear"), "yoe_min": F.lit(years)})
        assert score_rows(one, rubric, F.col).first().dim_scores["level"] == rung
    other = score_rows(facets, rubric, F.col).select(live_score(rubric, F.col("dim_scores"), F.lit(None), F.lit(None), {"level": 1.0}).alias("s"))
    assert [r.s for r in other.collect()] == [5.0, 4.0, 1.0, None]
    with pytest.warns(UserWarning, match="add up"):
        Rubric((Dimension("a", 40),))
    scalar = hard_filter_result((HardFilter("yoe_min", above=7),), F.col)
    assert [r[0] for r in facets.select(scalar["reason"]).collect()] == ["", "yoe_min > 7", "", ""]


def test_edits(spark):
    edits = spark.createDataFrame([("a", "decision", "keep"), ("a", "decision", "shortlist"), ("a", "fit", "6"), ("a", "fit", "x"), ("a", "manual_score", "")], "key string, field string, value string")
    good, bad = check_edits(edits, COMPANY_DECISIONS)
    assert sorted(r.value for r in good.collect()) == ["", "keep"] and bad.count() == 3


def test_watchlist_cap_counts_before_unusable_entries(spark):
    rows = spark.createDataFrame(
        [("a", None, "lever", "u", "undecided", False, 9, 9.0), ("b", "B", "lever", "u", "undecided", False, 9, 8.0), ("c", "C", "lever", "u", "keep", False, 0, 0.0), ("d", "D", "taleo", "u", "keep", False, 0, 0.0)],
        "key string, name string, provider string, careers_url string, decision string, excluded_by_type boolean, openings int, relevance_score double",
    )
    assert {r.key for r in queues.watchlist(rows, True, 1, 1).collect()} == {"c"}
    assert {r.key for r in queues.watchlist(rows, True, 1, -1).collect()} == {"b", "c"}


def test_lifecycle_order_of_sources(spark):
    apps = spark.createDataFrame(
        [("https://x.org/a", "Applied", None, 1), ("https://x.org/a", "Offer", "[1](reports/1-a.md)", 2), ("https://y.org/?gh_jid=7", None, None, 3)],
        "key string, status string, report string, ord int",
    )
    reports = spark.createDataFrame(
        [("1-a.md", "1", "https://x.org/a", 1), ("2-b.md", "2", "https://x.org/b", 2), ("3-b.md", "3", "https://x.org/b", 3), ("4-c.md", "4", "https://z.org/jobs/9", 4)],
        "file string, num string, url string, ord int",
    )
    tracker = spark.createDataFrame([("2", "Rejected"), ("3", "Offer")], "num string, status string")
    listings = spark.createDataFrame([("https://x.org/a",), ("https://x.org/b",), ("https://other.org/jobs/7",), ("https://other.org/roles/9",), ("https://none.org",)], "key string")
    got = {r.key: (r.status, r.report, r.tracked) for r in with_lifecycle(listings, *lifecycle_tables(apps, reports, tracker, "ord")).collect()}
    assert got == {
        "https://x.org/a": ("Offer", "1-a.md", True),  # an application beats a report; its last row counts
        "https://x.org/b": ("Rejected", "2-b.md", True),  # the first report of a URL counts
        "https://other.org/jobs/7": (None, None, True),
        "https://other.org/roles/9": ("Evaluated", "4-c.md", True),
        "https://none.org": (None, None, False),
    }


def test_null_keys_and_times_are_kept(spark):
    import datetime as dt

    from vacantia.operators.dedup import first_wins_two_keys
    from vacantia.operators.sequence import far_from_accepted, far_from_previous
    from vacantia.operators.skew import number_in_order

    day = lambda h: dt.datetime(2024, 1, 1, h)
    rows = spark.createDataFrame([(1, None), (2, day(3)), (3, day(1)), (4, day(1))], "id long, ts timestamp")
    got = {r.id: r.n for r in number_rows(rows, ["ts", "id"], time_chunk(F.col("ts"), 3600), "n").collect()}
    assert got == {1: 1, 3: 2, 4: 3, 2: 4}
    assert {r.id: r.n for r in number_in_order(rows, ["ts", "id"], "n").collect()} == got
    events = spark.createDataFrame([(1, "a", day(1)), (2, None, day(1)), (3, None, day(2)), (4, None, day(9)), (5, "a", None)], "id long, k string, ts timestamp")
    assert sorted(r.id for r in far_from_accepted(events, ["k"], "ts", "id", 4 * 3600).collect()) == [1, 2, 4]
    assert sorted(r.id for r in far_from_previous(events.where("ts IS NOT NULL"), ["k"], "ts", "id", 4 * 3600).collect()) == [1, 2, 4]
    two = spark.createDataFrame(
        [(1, None, None), (2, None, None), (3, None, "r"), (4, None, "r"), (5, "u", None), (6, "u", "s"), (7, "v", "r"), (8, "w", "s")], "o long, u string, r string"
    )
    assert sorted(r.o for r in first_wins_two_keys(two, "u", ["r"], "o").collect()) == [1, 2, 3, 5, 8]


def test_one_day_is_numbered_by_several_tasks(spark):
    from vacantia.operators.skew import number_in_order

    rows = spark.range(0, 4000, 1, 4).select(F.format_string("k%05d", "id").alias("key"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = number_in_order(rows, ["ts", "key"], "n").withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.n for r in sorted(got, key=lambda r: r.key)] == list(range(1, 4001))
    assert len({r.p for r in got}) > 1


# ── search texts as tables ───────────────────────────────────────────────


def some_names(rnd, n, alphabet="abcdeé日\U0001f600 "):
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


def test_contained_equals_brute_force(spark):
    rnd = random.Random(11)
    texts, needles = some_names(rnd, 300), some_names(rnd, 150) + ["a", "ab", "é", "日\U0001f600", " ", "zzz", "", None]
    df = lambda rows: spark.createDataFrame([(x,) for x in [*rows, *rows[:9], None]], "x string")
    got = contained(df(texts), df(needles)).collect()
    want = {(t, n) for t in texts for n in needles if t and n and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "x string")
    assert contained(none, df(needles)).count() == 0 and contained(df(texts), none).count() == 0


def test_ten_thousand_keywords(spark):
    """A third of all titles are one title; keywords that are parts of others, short, blank and repeated."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)]
    titles = [" ".join(rnd.choice(words) for _ in range(4)).title() for _ in range(600)] + ["Senior Engineer"] * 300 + [None, ""]
    positive = [*(rnd.choice(words)[:6] for _ in range(10_000)), "engine", "  NIOR ", "x", " ", None]
    negative = ["".join(rnd.choice("etaoinshr") for _ in range(4)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(titles)), "id long, title string")
    table = lambda words_: spark.createDataFrame([(w,) for w in words_], "w string")
    clean = lambda words_: [w.lower().strip() for w in words_ if w and w.strip()]
    pos, neg = clean(positive), clean(negative)
    want = {i for i, t in enumerate(titles) if any(k in (t or "").lower() for k in pos) and not any(k in (t or "").lower() for k in neg)}
    got = titles_passing(rows, "title", table(positive), table(negative))
    assert got.columns == ["id", "title"] and {r.id for r in got.collect()} == want and 0 < len(want) < len(titles)
    few = [*pos[:20], "engine"]
    by_column = {r.id for r in rows.where(title_passes(F.col("title"), few, neg[:5])).collect()}
    assert {r.id for r in titles_passing(rows, "title", table(few), table(neg[:5])).collect()} == by_column
    assert titles_passing(rows, "title", table([]), None).count() == len(titles)
    assert titles_passing(rows, "title", None, table([])).count() == len(titles)


def test_first_exclusion_from_a_table(spark):
    rnd = random.Random(13)
    rows = spark.createDataFrame(
        [(i, a or None, b, [c, None] if i % 3 else None) for i, (a, b, c) in enumerate(zip(*(some_names(rnd, 120) for _ in range(3)), strict=True))],
        "id long, a string, b string, tags array<string>",
    )
    keywords = [x.upper() for x in some_names(rnd, 40)] + [" AB ", "ab", "é", "  "]
    listed = spark.createDataFrame(list(enumerate(keywords)), "pos long, keyword string")
    want = {r.id: r.hit for r in rows.select("id", first_exclusion(keywords, F.col("a"), F.col("b"), tags=F.col("tags")).alias("hit")).collect()}
    got = {r.id: r.exclusion_matched for r in with_first_exclusion(rows, listed, ["a", "b"], "tags").collect()}
    assert got == want and len({x for x in got.values() if x}) > 3


def test_typed_texts_from_a_table(spark):
    rnd = random.Random(14)
    names = [f"{a} {b}" for a in ("Blue", "Red", "Old", "New") for b in ("Widget", "Gear", "Bolt")]
    listings = [(f"l{k}", rnd.choice(names), rnd.choice(names), k) for k in range(60)] + [("l90", None, "Only Title", 90)]
    applications = [(f"a{k}", rnd.choice([*names, "Acme Corp"]), rnd.choice([*names, None]), k) for k in range(40)]
    typed = [*(n.lower()[rnd.randrange(4) : 4 + rnd.randrange(6)] for n in names * 8), "Acme", "only title", "l3", "a7", "GEAR OLD", " ", "https://WWW.x.org/a/?utm_x=1", "nothing"]
    schema = "key string, company string, title string, ord long"

    def brute(t):
        if t.startswith("https"):
            return "https://x.org/a"
        if t in {a[0] for a in applications}:
            return t
        low = lambda x: (x or "").lower().strip()
        for k, c, n, _ in listings:
            if any(t.lower() in x for x in (low(c), low(n), f"{low(c)} {low(n)}")):
                return k
        return next((k for k, c, n, _ in applications if t.lower() in low(c) or t.lower() in low(n)), "")

    asked = spark.createDataFrame([(t,) for t in typed], "text string")
    got = {r.text: r.key for r in resolve_keys(asked, spark.createDataFrame(listings, schema), spark.createDataFrame(applications, schema), "ord").collect()}
    assert got == {t.strip(): brute(t.strip()) for t in typed if t.strip()}
    many = spark.range(100_000).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    assert resolve_keys(many, spark.createDataFrame(listings, schema), spark.createDataFrame(applications, schema), "ord").where("key <> ''").count() == 0
