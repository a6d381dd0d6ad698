"""Titles alike by a bound, slots inside answers, requests to skip, rows of timetables and chunks of documents, against brute force."""

import difflib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from calspark.functions import text as T
from calspark.operators import grid, slots


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("least", [0.45, 0.8])
def test_scored_equals_all_pairs_with_fewer_comparisons(spark, least):
    rng = random.Random(7)
    words = ["лекция", "зачёт", "экзамен", "кр", "химия", "физика", "ab", "zz top", "сдача дз", "", "—", "x"]
    titles = sorted({" ".join(rng.sample(words, rng.randint(0, 3))) for _ in range(60)}) + ["q" * 250]
    pairs = [(a, b) for a in titles for b in titles] + [(titles[0], None), (None, None)]
    df = spark.createDataFrame(pairs, "q string, t string")
    want = {(r["q"], r["t"]): r["s"] for r in df.select("q", "t", F.round(T.similarity(F.col("q"), F.col("t")), 6).alias("s")).collect() if r["s"] is not None and r["s"] >= least}
    got = T.scored(df.unionAll(df), "q", "t", least).collect()
    assert len(got) == 2 * len(want) and {(r["q"], r["t"]): r["score"] for r in got} == want
    asked = T.told_by_words(df.dropna().distinct(), "q", "t").filter(T.ratio_needed(least)).count()
    assert asked < len(pairs) * (0.8 if least == 0.45 else 0.4)


def test_titles_without_words_are_like_nothing(spark):
    df = spark.createDataFrame([("", ""), ("—", "лекция"), ("лекция", "!"), (None, "a")], "q string, t string")
    assert [r[0] for r in df.select(T.similarity(F.col("q"), F.col("t"))).collect()] == [0.0, 0.0, 0.0, None]


def test_slots_of_answers(spark):
    deep = '{"slots": [{"_a": [{"__b": 1}]}]}'
    for _ in range(200):
        deep = '{"x": ' + deep + "}"
    answers = ["```json\n[1, {\"_t\": 2}]\n```", 'so: {"_slots": [{"t": "a"}]} end', '{"a": {"slots": 3, "b": {"slots": [4]}}, "slots_": 1}', '{"slots": "none", "x": {"slots": [1]}}', '{"a": [{"slots": [1]}]}', '{"b": {"slots": [1]}, "a": {"slots": [2]}}', deep, "{broken", "", None, '{"slots": []}', "[" * 100000]
    got = [r[0] for r in spark.createDataFrame([(a,) for a in answers], "a string").select(T.slots_of(F.col("a"))).collect()]
    assert got == [["1", '{"t": 2}'], ['{"t": "a"}'], ["4"], None, None, ["1"], [json.dumps({"a": [{"b": 1}]})], None, None, None, [], None]


def test_skip_candidates(spark):
    requests = spark.createDataFrame([(1, 1, "не пойду на Физику, пропущу лекцию Химия"), (2, 1, "сегодня не иду"), (3, 1, None), (4, 2, "химия"), (5, 1, "Зачет!")], "request_id int, account int, message string")
    classes = spark.createDataFrame([(1, 10, "химия"), (1, 11, "Зачёт"), (1, 12, None), (3, 13, "химия")], "account int, class int, title string")
    got = sorted((r["request_id"], r["class"]) for r in slots.skip_candidates(requests, classes, ["account"]).collect())
    assert got == [(1, 10), (2, 10), (2, 11), (2, 12), (3, 10), (3, 11), (3, 12), (5, 11)]
    assert slots.skip_candidates(requests, classes.limit(0), ["account"]).count() == 0


def test_row_slots(spark):
    rows = [
        ["Время", "Предмет", "9:00"], ["Вторник", "8:15 - 9:45", "Алгебра", "каб. 5"], ["Среда", "10.00-11.30 (знаменатель)", "Рисунок", " Рисунок", "3", "ТМ-12"], ["12:10", "Черчение, нечет", "№ 4"],
        ["Пт, Сб", "14:00", "Хор"], ["23:00", "Театр"], ["12:00 10:00", "Спорт"], ["Понедельник"], ["без времени"], ["7:00", None, "—", "Танцы"],
    ]
    cells = [(1, i, j, x) for i, r in enumerate(rows) for j, x in enumerate(r)]
    got = [tuple(r)[1:] for r in grid.row_slots(spark.createDataFrame(cells, "file_id int, row_no int, col_no int, text string")).orderBy("row_no").collect()]
    assert got == [
        (1, 1, 495, 585, None, None, False), (2, 2, 600, 690, "Рисунок", "even", True), (3, 2, 730, 820, "Черчение, нечет", "odd", True), (4, 2, 840, 930, "Хор", "every", True),
        (5, 2, 1380, 1470, None, None, False), (6, 2, 720, 600, None, None, False), (9, 0, 420, 510, "Танцы", "every", True),
    ]


def chunks(lines, most):
    """Brute force: whole texts joined at each step."""
    sections = []
    for line in lines:
        if line.startswith("=== ") or not sections:
            sections.append([])
        sections[-1].append(line)
    parts = []
    for own in sections:
        if len("\n".join(own).strip()) <= most:
            parts.append("\n".join(own).strip())
            continue
        n = 0
        while n < len(own) and n < 12 and sum(bool(re.match(r"(?:T[0-9]+)?R[0-9]+\t", x)) for x in own[:n]) < 4:
            n += 1
        now = own[:n]
        for line in own[n:]:
            if len("\n".join([*now, line]).strip()) > most:
                parts.append("\n".join(now).strip())
                now = own[:n]
            now = [*now, line]
        parts.append("\n".join(now).strip())
    out = []
    for p in filter(None, parts):
        if out and len(out[-1]) + len(p) + 1 <= most:
            out[-1] += "\n" + p
        else:
            out.append(p)
    return out


def test_document_chunks_equal_brute_force(spark):
    rng = random.Random(3)
    line = lambda: rng.choice(["=== s ===", "", "  ", "", " " * 70, "R1\tx", "T2R31\ty y", "text " * rng.randint(0, 9), " \tz ", "w" * rng.randint(0, 200), "ж é "])
    docs = {d: [line() for _ in range(rng.randint(1, 90))] for d in range(40)} | {40: [""], 41: ["a" * 500], 42: ["=== t", *["R9\t" + "b" * 30] * 60]}
    rows = [(d, i, x, 1) for d, own in docs.items() for i, x in enumerate(own)] + [(43, 0, None, 1)]
    df = spark.createDataFrame(rows, "doc int, i int, text string, chunk int")
    got = {}
    for r in grid.document_chunks(df, "doc", "i", 150).orderBy("doc", "chunk").collect():
        assert r["chunk"] == len(got.setdefault(r["doc"], [])) and r["n_chars"] == len(r["text"])
        got[r["doc"]].append(r["text"])
    assert got == {d: c for d, own in docs.items() if (c := chunks(own, 150))}
    assert grid.document_chunks(df.limit(0), "doc", "i").count() == 0


def test_row_chunks(spark):
    cells = [(1, r, c, "x" * 6) for r in range(6) for c in range(20)] + [(2, 0, 0, "y" * 500), (2, 1, 0, None), (2, 2, 0, "z")] + [(3, 0, c, "") for c in range(60)]
    df = spark.createDataFrame(cells, "file_id int, row_no int, col_no int, text string")
    got = {f: [r["chunk"] for r in grid.row_chunks(df).orderBy("row_no").collect() if r["file_id"] == f] for f in (1, 2, 3)}
    assert got == {1: [0, 0, 1, 1, 2, 2], 2: [0, 0, 0], 3: [0]}
    assert [r["chunk"] for r in grid.row_chunks(df.filter("file_id = 2"), 100).orderBy("row_no").collect()] == [0, 1, 1]


def test_skip_candidates_compare_words_once(spark):
    """Pairs of a request and a class are made on equal keys; words are compared before, once for each group and spelling."""
    requests = spark.range(600).selectExpr("id AS request_id", "id % 2 AS account", "CASE WHEN id % 3 = 0 THEN 'не иду химия' ELSE 'не иду' END AS message")
    classes = spark.range(600).selectExpr("id AS class", "id % 2 AS account", "CASE WHEN id % 5 = 0 THEN 'Химия 2' ELSE 'Хор' END AS title")
    found = slots.skip_candidates(requests, classes, ["account"])
    assert "arrays_overlap" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(r, c) for r in range(600) for c in range(600) if (r - c) % 2 == 0 and (r % 3 or c % 5 == 0)]
    assert sorted((r["request_id"], r["class"]) for r in found.collect()) == want


def test_skip_candidates_in_tiles_equal_brute_force(spark, monkeypatch):
    """Blocks that aren't full, equal rows, nulls in every column and groups without requests or classes."""
    monkeypatch.setattr(slots, "TILE", (3, 4), raising=False)
    monkeypatch.setattr(slots, "PAIRS_OF_A_TASK", 50, raising=False)
    rng = random.Random(5)
    titles, messages = ["Химия", "химия  ", "Зачёт", "физика 2", "", None, "Не"], ["не иду Химия", "Не иду ЗАЧЕТ, физика", "иду", "", None, "астрономия"]
    requests = [(i, rng.choice([1, 1, 2, 3, None]), rng.choice("ab"), rng.choice(messages)) for i in range(90)] + [(None, 1, "a", "химия")]
    classes = [(rng.choice([None, *range(9)]), rng.choice(titles), rng.choice([1, 1, 2, 4, None]), rng.choice("ab"), rng.choice([None, 0.5, 2.0])) for _ in range(110)]
    words = lambda text: set(re.findall("[a-zа-я0-9]+", (text or "").lower().replace("ё", "е")))
    want = []
    for request, *group, message in requests:
        there = [(c, title, x) for c, title, *own, x in classes if own == group and group[0] is not None]
        meant = [c for c in there if words(c[1]) & (words(message) - set(T.SKIP_WORDS))]
        want += [(request, *c) for c in meant or there]
    asked = spark.createDataFrame(requests, "request_id int, account int, kind string, message string")
    found = slots.skip_candidates(asked, spark.createDataFrame(classes, "class int, title string, account int, kind string, x double"), ["account", "kind"])
    assert found.columns == ["request_id", "class", "title", "x"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_skip_candidates_of_a_group_are_dealt_out(spark, monkeypatch):
    """A million pairs of one group are the work of many tasks, not of the one that its key falls to."""
    monkeypatch.setattr(slots, "TILE", (32, 64), raising=False)
    monkeypatch.setattr(slots, "PAIRS_OF_A_TASK", 1 << 16, raising=False)
    requests = spark.range(1000).selectExpr("id AS request_id", "1 AS account", "if(id % 2 = 0, 'не иду', 'химия') AS message")
    classes = spark.range(1000).selectExpr("id AS class", "1 AS account", "if(id % 10 = 0, 'хор', 'Химия') AS title")
    found = slots.skip_candidates(requests, classes, ["account"])
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 500 * 1000 + 500 * 900 and len(tasks) > 8 and max(tasks) < sum(tasks) / 4
