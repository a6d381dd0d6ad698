"""Queries that run over whole tables: no window of ids, no filter of rows that are hard to compare."""

import difflib
from collections import Counter

from calspark import catalog
from calspark.plans.views import Tables

SF = "/root/testdata/sf0.001"


def test_similar_titles_of_all_events(spark):
    """Every ordered pair of a user's titles, by brute force; titles here are words of Latin letters without aliases."""
    own = {}
    for r in Tables(spark, SF).cal_events.select("user_id", "title").collect():
        own.setdefault(r["user_id"], Counter())[r["title"]] += 1

    def score(a, b):
        if a == b:
            return 1.0
        if a in b or b in a:
            return 0.96
        words = set(a.split())
        return round(max(difflib.SequenceMatcher(None, a, b).ratio(), 0.9 * len(words & set(b.split())) / len(words)), 6)

    want = {(u, a, b): (n[a], n[b], score(a, b)) for u, n in own.items() for a in n for b in n if a != b or n[a] > 1}
    got = catalog.queries()["t6_title_similarity"](spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        n, m, s = want[r["user_id"], r["title"], r["other"]]
        assert (r["n_events"], r["n_others"]) == (n, m) and abs(r["score"] - s) < 2e-6


def test_week_marks_of_all_slots(spark):
    want = []
    for r in Tables(spark, SF).slots.select("position", "title").collect():
        p, a, title = r["position"], 1 + r["position"] % 4, r["title"]
        capital = title[:1].upper() + title[1:]
        want.append((p, *((",".join(map(str, range(a, a + 4))), "", capital), ("", "1,5", capital), ("", "", title))[p % 3]))
    got = catalog.queries()["t16_week_marks"](spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def table(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_texts_of_any_letters(spark, tmp_path):
    """Turns outside ASCII, quoted, with marks at their ends, or with a request to skip; each by hand."""
    rows = [(1, 4, "привет, мир"), (1, 0, ", начало"), (1, 1, "«в кавычках»"), (1, 2, "end;"), (2, 4, "skip it"), (2, 0, "skipper"), (2, 5, "please skip"), (3, 0, "123"), (3, 1, None), (3, 3, "восемь!")]
    sf = table(spark, tmp_path, "conversations", rows, "conv_id long, turn long, text string")
    run = lambda name, column: {(r["conv_id"], r["turn"]): r[column] for r in catalog.queries()[name](spark, sf).collect()}
    assert run("t2_mark_cleanup", "text") == {(1, 4): "привет, мир ok", (1, 0): ", начало ok", (1, 1): "«в кавычках» ok", (1, 2): "end; ok", (2, 4): "skip it ok", (2, 0): "skipper ok", (2, 5): "please skip ok", (3, 0): "123 ok", (3, 1): None, (3, 3): "восемь! ok"}
    assert run("t18_transcripts", "text") == {(1, 4): "привет, мир", (1, 0): ", начало", (1, 1): "в кавычках", (1, 2): "end;", (2, 4): "skip it", (2, 0): "skipper", (2, 5): "please skip", (3, 0): "", (3, 1): None, (3, 3): "восемь!"}
    assert run("t11_intent", "intent") == {(1, 4): "new", (1, 0): "cancel", (1, 1): "rename", (1, 2): "edit", (2, 4): "skip", (2, 0): "cancel", (2, 5): "skip", (3, 0): "cancel", (3, 1): "new", (3, 3): "skip"}


def test_titles_of_all_documents(spark, tmp_path):
    rows = [(1, "ßeta"), (2, " ñandú "), (3, None), (4, "  "), (5, "зачёт"), (6, "x" * 300)]
    sf = table(spark, tmp_path, "documents", rows, "doc_id long, text string")
    want = {1: "SSeta", 2: "Ñandú", 3: "Event", 4: "Event", 5: "Зачёт", 6: "X" + "x" * 254}
    assert {r["doc_id"]: r["title"] for r in catalog.queries()["t3_event_title"](spark, sf).collect()} == want
