"""Long intervals, merges in order, keys kept for good, gates that forget; expectations by hand or brute force."""

import datetime as dt
import random

from pyspark.sql import functions as F

from calspark.operators import identity, intervals
from calspark.streaming import jobs

M = dt.datetime


def test_overlaps_of_long_intervals_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(150):
        start = M(2023, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 700 * 1440))
        rows.append((i, f"s{i % 3}", start, start + dt.timedelta(minutes=rnd.choice([0, 30, 90, 1440, 5000, 366 * 1440]))))
    rows += [(200, "s0", M(1969, 12, 20), M(1970, 1, 9)), (201, "s0", M(1970, 1, 1), M(1970, 1, 2)), (202, None, M(1970, 1, 1), M(1970, 1, 2)), (203, "s1", None, None)]
    df = spark.createDataFrame(rows, "id int, subject string, start_at timestamp_ntz, end_at timestamp_ntz")
    got = sorted((r["a"]["id"], r["b"]["id"]) for r in intervals.bucketed_overlaps(df, df, "subject").collect())
    known = [r for r in rows if r[1] and r[2]]
    assert got == sorted((a[0], b[0]) for a in known for b in known if a[1] == b[1] and a[2] < b[3] and a[3] > b[2])


def test_a_year_is_few_nodes(spark):
    spans = [(19723, 20088), (19723, 19723), (0, 2047), (1, 2046), (-10, 9)]
    df = spark.createDataFrame(spans, "a int, b int").select("a", "b", intervals.dyadic(F.col("a"), F.col("b")).alias("nodes"))
    for r in df.collect():
        days = sorted(d for n in r["nodes"] for d in range(n["place"] << n["level"], (n["place"] + 1) << n["level"]))
        assert days == list(range(r["a"], r["b"] + 1)) and len(r["nodes"]) <= max(1, 2 * (r["b"] - r["a"] + 1).bit_length())


def test_requests_to_merge_are_judged_in_order(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "b"), (9, "a")], "account_id long, platform string")
    requests = [(1, 1, 3), (2, 2, 3), (3, 4, 6), (4, 6, 5), (5, 4, 5), (6, 5, 5), (7, 9, 7), (8, 7, 8)]
    judged, roots = identity.merged_in_order(spark.createDataFrame(requests, "request_no long, account_id long, new_account_id long"), own)
    assert sorted((r["request_no"], r["reject"]) for r in judged.collect()) == [(1, None), (2, "platform"), (3, None), (4, None), (5, "same"), (6, "same"), (7, None), (8, None)]
    assert {r["account_id"]: r["root"] for r in roots.collect()} == {1: 3, 2: 2, 3: 3, 4: 5, 5: 5, 6: 5, 7: 8, 8: 8, 9: 8}


def test_merges_equal_brute_force(spark):
    rnd = random.Random(3)
    own = [(i, p) for i in range(14) for p in "ab" if rnd.random() < 0.3]
    requests = [(n, rnd.randrange(14), rnd.randrange(14)) for n in range(12)]
    root, have, want = {i: i for i in range(14)}, {i: {p for j, p in own if j == i} for i in range(14)}, []
    for n, a, b in requests:
        x, y = root[a], root[b]
        reject = "same" if x == y else "platform" if have[x] & have[y] else None
        want.append((n, reject))
        if reject is None:
            have[y] |= have[x]
            root = {i: y if r == x else r for i, r in root.items()}
    judged, roots = identity.merged_in_order(spark.createDataFrame(requests, "request_no long, account_id long, new_account_id long"), spark.createDataFrame(own, "account_id long, platform string"))
    assert sorted((r["request_no"], r["reject"]) for r in judged.collect()) == want
    assert all(root[r["account_id"]] == r["root"] for r in roots.collect())


def test_the_preferred_identity_comes_first(spark):
    own = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "a", 4)], "account_id long, platform string, external_id long")
    assert sorted(map(tuple, identity.first_identity(own).collect())) == [(1, "b", 3), (2, "a", 4)]
    assert sorted(map(tuple, identity.first_identity(own, "a").collect())) == [(1, "a", 5), (2, "a", 4)]


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))


def test_keys_stay_known(spark, tmp_path):
    """Thirty days later, after a restart, and with failures that leave the key open."""
    schema, place = "key string, at timestamp, n long, ok boolean", str(tmp_path / "kept")
    source = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    written(spark, tmp_path, "in", [("k", M(2024, 1, 1), 1, True), ("k", M(2024, 1, 1), 2, True), ("f", M(2024, 1, 1), 3, False)], schema)
    assert sorted(r["n"] for r in jobs.kept_once(source(), ["key"], "n", place, F.col("ok")).collect()) == [1, 3]
    written(spark, tmp_path, "in", [("k", M(2024, 1, 31), 4, True), ("f", M(2024, 1, 31), 5, True), ("new", M(2024, 1, 31), 6, True), (None, M(2024, 1, 31), 7, True)], schema)
    assert sorted(r["n"] for r in jobs.kept_once(source(), ["key"], "n", place, F.col("ok")).collect()) == [1, 3, 5, 6, 7]
    written(spark, tmp_path, "in", [("f", M(2024, 3, 1), 8, True), ("k", M(2024, 3, 1), 9, True)], schema)
    assert sorted(r["n"] for r in jobs.kept_once(source(), ["key"], "n", place, F.col("ok")).collect()) == [1, 3, 5, 6, 7]


def test_gates_forget(spark, tmp_path):
    """State goes when nothing was heard of an event for the horizon, and the gate is open again."""
    schema = "event_id long, at timestamp, kind string, item_id long"
    batches = [
        [(e, M(2024, 1, 1), "reminder", e) for e in range(20)], [(0, M(2024, 1, 2), "reminder", 100), (99, M(2024, 1, 5), "reminder", 101)], [(99, M(2024, 3, 1), "ack", 102)],
        [(98, M(2024, 3, 2), "reminder", 103)], [(1, M(2024, 3, 3), "reminder", 104), (99, M(2024, 3, 3), "reminder", 105)],
    ]
    for rows in batches:
        written(spark, tmp_path, "in", rows, schema)
    stream = jobs.gated(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(sizes) >= 20 and sizes[-1] <= 4
    got = {r["item_id"]: r["decision"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == "send" and got[100] == "blocked" and got[104] == "send" and got[105] == "send"


def test_unfolded_intervals_are_not_broadcast(spark):
    """However small the rows are that intervals are unfolded from; and buckets of an hour give the pairs that those of a day give."""
    at = F.lit(M(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), (F.col("id") * 25).cast("int"))
    rows = spark.range(300).select((F.col("id") % 3).alias("subject"), "id", at.alias("start_at"), (at + F.expr("interval 100 minutes")).alias("end_at"))
    found = intervals.bucketed_overlaps(rows, rows, "subject", 3600)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    pairs = lambda df: sorted((r["a"]["id"], r["b"]["id"]) for r in df.collect())
    assert pairs(found) == pairs(intervals.bucketed_overlaps(rows, rows, "subject")) == [(i, j) for i in range(300) for j in range(300) if (i - j) % 3 == 0 and abs(i - j) * 25 < 100]
