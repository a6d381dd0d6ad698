"""Feeds and archives are dealt to files under the caps; what is over a cap is a row with the reason."""

import datetime as dt
import hashlib
import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from calspark import catalog
from calspark.sources import calendars, files


def test_a_large_feed_is_several_files(spark):
    """50,000 events of a subject: some 6.5 MB, more than a file may have."""
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    rows = spark.range(50_000).select(F.lit("s").alias("subject"), F.concat(F.lit("event-"), F.col("id").cast("string")).alias("uid"), F.lit("title").alias("title"), at.alias("start_at"), (at + F.expr("interval 1 hour")).alias("end_at"), F.lit(False).alias("all_day"))
    made = calendars.feeds(rows, "subject").select(F.concat("subject", F.lit("."), "part").alias("file_name"), F.col("text").cast("binary").alias("content")).cache()
    assert made.count() > 1 and made.filter(F.length("content") > calendars.MOST_BYTES).count() == 0
    got = calendars.events(made)
    assert got.filter("reject IS NULL").select("uid").distinct().count() == got.count() == 50_000


def test_files_over_the_cap_are_rejected(spark):
    df = spark.createDataFrame([("big.ics", bytearray(b"BEGIN:VEVENT\nUID:1\nEND:VEVENT\n" + b"x" * calendars.MOST_BYTES))], "file_name string, content binary")
    assert [(r["file_name"], r["uid"], r["reject"]) for r in calendars.events(df).collect()] == [("big.ics", None, "bytes")]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for i in range(22):
            archive.writestr(f"{i:02}.txt", b"x")
    df = spark.createDataFrame([("many.zip", bytearray(out.getvalue()))], "file_name string, content binary")
    assert [(r["member"], r["reject"]) for r in files.members(df).orderBy("member").collect()] == [(f"{i:02}.txt", None if i < 20 else "members") for i in range(22)]


def test_archives_keep_all_documents(spark, tmp_path):
    """Seven documents of 4 MB in a box, and 50 without an id."""
    large = [(i, f"{i}" * 4_000_000) for i in range(1, 7)] + [(0, "short")]
    rows = large + [(None, f"text {i}") for i in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(str, map(tuple, catalog.queries()["s2_archives"](spark, str(tmp_path)).collect())))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted(str((None, None, sha(t)) if i is None else ("0.zip", f"doc-{i}.txt", sha(t))) for i, t in rows)


def test_long_lines_are_folded_and_read_back(spark):
    """No line has over 75 bytes, no letter is cut, and titles come back as they were."""
    titles = ["short", "x" * 300, "Лабораторная работа, " * 20, "é" * 34 + "😀" * 60, "a" * 66, "a" * 67, "a" * 68, "one\ntwo\r\nthree; " + "ё" * 90, ""]
    at = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("s", f"{i}-" + "u" * 80, x, at, at, False) for i, x in enumerate(titles)], "subject string, uid string, title string, start_at timestamp_ntz, end_at timestamp_ntz, all_day boolean")
    made = calendars.feeds(rows, "subject").select(F.lit("f").alias("file_name"), F.col("text").cast("binary").alias("content"))
    content = bytes(made.collect()[0]["content"])
    lines = content.split(b"\r\n")
    assert max(map(len, lines)) <= 75 and all(x.decode() is not None for x in lines)
    assert b"SUMMARY:" + b"a" * 67 in lines and b"SUMMARY:" + b"a" * 68 not in lines
    got = {int(r["uid"].split("-")[0]): r["summary"] for r in calendars.events(made).collect()}
    assert got == {i: x.replace("\r\n", "\n").strip() or None for i, x in enumerate(titles)}


def test_the_digest_of_a_large_feed_is_of_one_text(spark):
    """Over 5 MB of one subject, which ``feeds`` cuts, beside a short one."""
    at = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    rows = spark.range(50_000).select(F.when(F.col("id") < 3, "t").otherwise("s").alias("subject"), F.concat(F.lit("event-"), F.col("id").cast("string")).alias("uid"), F.lit("title").alias("title"), at.alias("start_at"), (at + F.expr("interval 1 hour")).alias("end_at"), F.lit(False).alias("all_day"))
    own = {"s": sorted(f"event-{i}" for i in range(3, 50_000)), "t": [f"event-{i}" for i in range(3)]}
    event = "BEGIN:VEVENT\r\nUID:{}\r\nSUMMARY:title\r\nDTSTART:20240101T000000Z\r\nDTEND:20240101T010000Z\r\nEND:VEVENT\r\n"
    text = lambda uids: "BEGIN:VCALENDAR\r\nVERSION:2.0\r\nPRODID:-//calspark//feed//EN\r\nCALSCALE:GREGORIAN\r\nMETHOD:PUBLISH\r\n" + "".join(map(event.format, uids)) + "END:VCALENDAR\r\n"
    got = sorted(map(tuple, calendars.feed_digests(rows, "subject").collect()))
    assert got == [(s, len(u), hashlib.sha256(text(u).encode()).hexdigest()) for s, u in sorted(own.items())]


def test_what_is_unpacked_is_given_back_in_pieces():
    """Forty archives of one batch, 40 MB unpacked: no piece has more than the bytes of a batch and one member."""
    def packed(i):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{i}.txt", bytes([i]) * 1_000_000)
        return out.getvalue()

    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.zip" for i in range(41)]), pa.array([*map(packed, range(40)), b"none"], pa.binary())], names=["file_name", "content"])
    found = list(files._members(iter([batch])))
    assert len(found) > 5 and max(b.nbytes for b in found) < files.BATCH_BYTES + 1_100_000
    rows = [tuple(r.values()) for b in found for r in b.to_pylist()]
    assert rows == [(f"{i}.zip", f"{i}.txt", bytes([i]) * 1_000_000, None) for i in range(40)] + [("40.zip", None, None, "broken")]
