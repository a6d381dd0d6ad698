"""Queries over texts: documents, dialogue turns, links and messages made from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calspark.functions import text as T
from calspark.operators import slots
from calspark.operators.saved import saved

from .registry import query

NOISE = "|".join(T.NOISE).replace("dimatorzok", "(?i:dimatorzok)")


@query("t1_masks")
def _(t):
    """Java's look-behind has no counterpart in DuckDB; a test compares it with brute force."""
    return t.documents.select("doc_id", F.sha2(T.masked(F.col("text")), 256).alias("masked_sha256"), F.expr("char_length(text)").alias("n"))


@query("t1_email_mask", r"SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')) AS masked_sha256 FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.regexp_replace("text", T.EMAIL, T.EMAIL_MARK), 256).alias("masked_sha256"))


# A character of a word, and white space, as Java takes them; DuckDB's own \b and \s know less.
WORD, SPACE = r"\p{L}\p{M}\p{Nd}\p{Pc}", r"[\t\n\v\f\r ]"


@query("t2_mark_cleanup", rf"""
WITH m AS (SELECT conv_id, turn, regexp_replace(text || ' [ССЫЛКА] ( ) ok , [ТЕЛЕФОН]', '(^|[^{WORD}])(?:на|по|от|to|at|by) \[(?:ССЫЛКА|ТЕЛЕФОН|EMAIL)\]', '\1 ', 'g') AS text FROM conversations),
  u AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\[(?:ССЫЛКА|ТЕЛЕФОН|EMAIL)\]', ' ', 'g'), '\({SPACE}*\)|\[{SPACE}*\]', ' ', 'g') AS text FROM m)
SELECT conv_id, turn, trim(rtrim(regexp_replace(regexp_replace(text, '{SPACE}+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g'), ' ,;:')) AS text FROM u""")
def _(t):
    return t.conversations.select("conv_id", "turn", T.without_marks(F.concat("text", F.lit(" [ССЫЛКА] ( ) ok , [ТЕЛЕФОН]"))).alias("text"))


@query("t3_event_title", "SELECT doc_id, left(upper(replace(left(coalesce(nullif(trim(text), ''), 'Event'), 1), 'ß', 'SS')) || substr(coalesce(nullif(trim(text), ''), 'Event'), 2), 255) AS title FROM documents")
def _(t):
    """DuckDB has no capital of the sharp s, so its SQL says it."""
    return t.documents.select("doc_id", T.event_title(F.col("text"), "Event").alias("title"))


@query("t4_collapse", r"SELECT conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 1200) AS text FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", T.collapsed(F.col("text")).alias("text"))


@query("t5_normal_title", r"SELECT l_orderkey, l_linenumber, lower(regexp_replace(regexp_replace(p_name || ' - ' || p_type, '[^A-Za-z0-9_]+', ' ', 'g'), '^ | $', '', 'g')) AS title FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t):
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select("l_orderkey", "l_linenumber", T.normal_title(F.concat_ws(" - ", "p_name", "p_type")).alias("title"))


#: Rows of two titles and a score that are broadcast, at most: some 50 MB.
MOST_SCORES = 250_000


@query("t6_title_similarity")
def _(t):
    """Each title of a user as the query against each other one, both ways, and against itself if several events have it.

    n_events and n_others count the events with either title; a pair of titles is scored once, however many users have it.
    Events without a title have no pairs. The ratio has no counterpart in SQL. Scores of up to MOST_SCORES pairs of titles are sent to where
    the users' pairs are made; more are joined by sorting.
    """
    e = saved(t.cal_events.filter("title IS NOT NULL").groupBy("user_id", "title").agg(F.count(F.lit(1)).alias("n_events")))
    other = e.select("user_id", F.col("title").alias("other"), F.col("n_events").alias("n_others"))
    pairs = e.join(other, "user_id").filter((F.col("title") != F.col("other")) | (F.col("n_events") > 1))
    scores = saved(pairs.select("title", "other").distinct().withColumn("score", F.round(T.similarity(F.col("title"), F.col("other")), 6)))
    few = scores.limit(MOST_SCORES + 1).count() <= MOST_SCORES
    return pairs.join(F.broadcast(scores) if few else scores, ["title", "other"]).select("user_id", "title", "other", "n_events", "n_others", "score")


@query("t6_similar_titles")
def _(t):
    """The titles of a user that are alike by 0.45 at least, each as the query against each other one; scores as in ``t6_title_similarity``."""
    e = t.cal_events.select("user_id", "title").distinct()
    pairs = e.join(e.withColumnRenamed("title", "other"), "user_id").filter("title <> other")
    return T.scored(pairs, "title", "other", 0.45).select("user_id", "title", "other", "score")


@query("t7_occurrence_date", """
WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS today, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS k, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 - 100 AS INT) AS DATE) AS d FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN today WHEN 1 THEN today + 1 WHEN 2 THEN today + 2 ELSE
  CASE WHEN make_date(year(today), month(d), least(day(d), 28)) < today - 1 THEN make_date(year(today) + 1, month(d), least(day(d), 28)) ELSE make_date(year(today), month(d), least(day(d), 28)) END END AS day FROM m""")
def _(t):
    d = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("today")).withColumn("d", F.date_add("today", (F.col("o_orderkey") % 200 - 100).cast("int")))
    message = F.when(F.col("o_orderkey") % 4 == 3, F.concat_ws(".", F.least(F.dayofmonth("d"), F.lit(28)).cast("string"), F.month("d").cast("string"))).otherwise(F.try_element_at(F.array(*map(F.lit, ("сегодня", "завтра", "послезавтра"))), (F.col("o_orderkey") % 4 + 1).cast("int")))
    return d.select("o_orderkey", T.occurrence_date(F.concat(F.lit("зачёт "), message), F.col("today")).alias("day"))


@query("t8_date_range", """
WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 500 - 20 AS INT) AS DATE) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b >= a AND b - a <= 370 THEN a END AS first, CASE WHEN b >= a AND b - a <= 370 THEN b END AS last, CASE WHEN b < a THEN 'order' WHEN b - a > 370 THEN 'long' END AS error FROM m""")
def _(t):
    m = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("a")).withColumn("b", F.date_add("a", (F.col("o_orderkey") % 500 - 20).cast("int")))
    day = lambda c: F.date_format(c, "dd.MM.yyyy")
    r = T.date_range(F.concat(F.lit("с "), day("a"), F.lit(" по "), day("b")), F.col("a"))
    return m.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.first", "r.last", "r.error")


# A message of each order, as the queries make it, and its dates.
DAY_SQL, DATE_SQL = "strftime(CAST(o_orderdate AS DATE), '%d.%m.%Y')", r"'[0-9]{2}\.[0-9]{2}\.[0-9]{4}'"


@query("t9_bare_period", f"""
WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'период с ' || {DAY_SQL} || ' по ' || {DAY_SQL} WHEN 1 THEN 'экзамен с ' || {DAY_SQL} || ' по ' || {DAY_SQL} ELSE 'период с ' || {DAY_SQL} END AS message FROM orders)
SELECT o_orderkey, len(regexp_extract_all(message, {DATE_SQL})) = 2 AND len(list_filter(regexp_extract_all(regexp_replace(message, {DATE_SQL}, ' ', 'g'), '[а-яa-z]+'), lambda w: NOT list_contains({T.FILLER}, w))) = 0 AS bare FROM m""")
def _(t):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("период с "), day, F.lit(" по "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("экзамен с "), day, F.lit(" по "), day)).otherwise(F.concat(F.lit("период с "), day))
    return t.orders.select("o_orderkey", T.is_bare_period(message).alias("bare"))


@query("t11_intent", rf"""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN 'new' WHEN turn % 5 = 3 OR regexp_matches(lower(text), '(^|[^{WORD}])(пропустить|пропусти|не будет|skip)([^{WORD}]|$)') THEN 'skip'
  WHEN turn % 5 = 0 THEN 'cancel' WHEN turn % 5 = 1 THEN 'rename' WHEN turn % 5 = 2 THEN 'edit' ELSE 'new' END AS intent FROM conversations""")
def _(t):
    """A turn with a request to skip is one, whatever it begins with."""
    head = F.element_at(F.array(*map(F.lit, ("отмени ", "переименуй ", "перенеси ", "пропусти ", "запиши "))), (F.col("turn") % 5 + 1).cast("int"))
    return t.conversations.select("conv_id", "turn", T.intent(F.concat(head, "text")).alias("intent"))


@query("t12_time_hint", r"""
WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'встреча в ' || strftime(ts, '%H:%M') WHEN 1 THEN 'каб. ' || strftime(ts, '%H:%M:%S') WHEN 2 THEN 'до ' || strftime(ts, '%H.%M') || '. Потом ' || event_type ELSE event_type || ' ' || CAST(event_id AS VARCHAR) END AS message FROM events)
SELECT event_id, regexp_matches(message, '(^|[^0-9.:])([01]?[0-9]|2[0-3])[:.][0-5][0-9]($|[^0-9.:]|[.:]([^0-9]|$))') AS timed FROM m""")
def _(t):
    """A clock, one with seconds, which is none, one in front of a full stop, and numbers only."""
    n, at = F.col("event_id") % 4, lambda form: F.date_format("ts", form)
    message = F.when(n == 0, F.concat(F.lit("встреча в "), at("HH:mm"))).when(n == 1, F.concat(F.lit("каб. "), at("HH:mm:ss"))).when(n == 2, F.concat(F.lit("до "), at("HH.mm"), F.lit(". Потом "), "event_type")).otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))
    return t.events.select("event_id", T.has_time_hint(message).alias("timed"))


@query("t13_clocks", "SELECT event_id, hour(ts) * 60 + minute(ts) AS first_clock, CASE WHEN (hour(ts) * 60 + minute(ts)) = 570 THEN 1 ELSE 2 END AS n FROM events")
def _(t):
    found = T.clocks(F.concat(F.date_format("ts", "HH:mm"), F.lit(" room 12.345, then 9.30 and 09:30")))
    return t.events.select("event_id", found[0].cast("long").alias("first_clock"), F.size(found).alias("n"))


@query("t14_cell_tests", r"SELECT file_id, row_no, col_no, regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS pure_date, regexp_matches(text, ' [0-9]{2}:30$') AS timed FROM v_cells")
def _(t):
    return t.cells.select("file_id", "row_no", "col_no", T.is_pure_date(F.col("text")).alias("pure_date"), (F.size(T.clocks(F.col("text"))) > 0).alias("timed"))


@query("t15_cell_text", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS text FROM lineitem")
def _(t):
    number = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".0"))
    date = F.concat(F.to_date("l_shipdate").cast("string"), F.lit(" 00:00:00"))
    even = F.col("l_linenumber") % 2 == 0
    return t.lineitem.select("l_orderkey", "l_linenumber", T.cell_text(F.when(even, "number").otherwise("date"), F.when(even, number).otherwise(date)).alias("text"))


@query("t16_week_marks", """
SELECT position, CASE WHEN position % 3 = 0 THEN array_to_string(generate_series(1 + position % 4, 4 + position % 4), ',') ELSE '' END AS weeks, CASE WHEN position % 3 = 1 THEN '1,5' ELSE '' END AS except_weeks, CASE WHEN position % 3 = 2 THEN title ELSE upper(left(title, 1)) || substr(title, 2) END AS title
FROM v_slots""")
def _(t):
    """Titles of slots with marks of all weeks but two, of four weeks, or with none, taken apart; the last stay as they are."""
    rows = t.slots.withColumn("a", 1 + F.col("position") % 4)
    span = F.concat(F.col("a").cast("string"), F.lit("-"), (F.col("a") + 3).cast("string"), F.lit(" н. "), "title")
    marked = F.when(F.col("position") % 3 == 1, F.concat(F.lit("кр. 5,1 н. "), "title")).when(F.col("position") % 3 == 0, span).otherwise(F.col("title"))
    m = rows.select("position", T.week_marks(marked).alias("m"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return m.select("position", joined(F.col("m.weeks")).alias("weeks"), joined(F.col("m.except_weeks")).alias("except_weeks"), "m.title")


@query("t20_evidence", r"""
WITH m AS (SELECT p_partkey, p_type, lower(CASE WHEN p_partkey % 2 = 0 THEN 'room: ' || p_type WHEN p_partkey % 3 = 0 THEN p_type || ' twice' ELSE p_name END) AS source FROM part),
  w AS (SELECT *, list_filter(regexp_extract_all(lower(p_type), '[a-z0-9_]+'), lambda w: length(w) >= 4) AS words FROM m)
SELECT p_partkey, len(words) > 0 AND len(list_filter(words, lambda w: NOT contains(source, left(w, 5)))) = 0 AS supported FROM w""")
def _(t):
    """Titles in a text that has them, in one that goes on, and in one that may not."""
    source = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("room: "), "p_type")).when(F.col("p_partkey") % 3 == 0, F.concat("p_type", F.lit(" twice"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", T.supported(F.col("p_type"), source).alias("supported"))


@query("t21_selection_key", "SELECT p_partkey, lower(replace(replace(p_name || '-' || p_type, ' ', ''), '-', '')) AS key FROM part")
def _(t):
    return t.part.select("p_partkey", T.selection_key(F.concat_ws("-", "p_name", "p_type")).alias("key"))


@query("t22_links", r"SELECT page_id, replace(url, 'http://', 'https://') AS link, regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') AS name FROM pages")
def _(t):
    webcal = F.concat(F.lit("see "), F.regexp_replace("url", "^https?://", "webcal://"))
    link = T.calendar_link(webcal)
    return t.pages.select("page_id", link.alias("link"), T.link_name(link).alias("name"))


@query("t23_interval_label", """
SELECT event_id, CASE WHEN all_day THEN CASE WHEN CAST(start_at AS DATE) = CAST(deadline - INTERVAL 1 DAY AS DATE) THEN strftime(start_at, '%d.%m.%Y') ELSE strftime(start_at, '%d.%m.%Y') || '-' || strftime(deadline - INTERVAL 1 DAY, '%d.%m.%Y') END
  ELSE strftime(start_at, '%d.%m.%Y %H:%M') || '-' || CASE WHEN CAST(start_at AS DATE) = CAST(deadline AS DATE) THEN strftime(deadline, '%H:%M') ELSE strftime(deadline, '%d.%m.%Y %H:%M') END END AS label FROM v_cal_events""")
def _(t):
    return t.cal_events.select("event_id", T.interval_label(F.col("start_at"), F.col("deadline"), F.col("all_day")).alias("label"))


@query("t24_source_label", r"""
WITH m AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.JPG' WHEN 1 THEN '.xlsx' WHEN 2 THEN '.heic' WHEN 3 THEN '.png.pdf' ELSE '.jpeg' END AS name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(name, '(?i)\.(png|jpe?g|webp|heic)$') THEN 'photo' ELSE name END AS label FROM m""")
def _(t):
    ending = F.element_at(F.array(*map(F.lit, (".JPG", ".xlsx", ".heic", ".png.pdf", ".jpeg"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", T.source_label(F.concat("p_name", ending)).alias("label"))


@query("t25_inbox_key", "SELECT event_id, sha256(coalesce(json_extract_string(props, '$.id'), json_extract_string(props, '$.k'), event_type)) AS inbox_key FROM events")
def _(t):
    return t.events.select("event_id", F.sha2(F.coalesce(F.get_json_object("props", "$.id"), F.get_json_object("props", "$.k"), "event_type"), 256).alias("inbox_key"))


@query("t26_html_escape", "SELECT page_id, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_sha256 FROM pages")
def _(t):
    return t.pages.select("page_id", F.sha2(T.html_escaped(F.col("html")), 256).alias("escaped_sha256"))


@query("t19_json_repair", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    answer = F.concat(F.lit("Here you are: ```json\n"), F.regexp_replace("props", '"k"', '"_k_"'), F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(T.repaired_json(answer), "$.k").alias("k"))


@query("t19_nested_slots", r"""
WITH a AS (SELECT event_id, 'Here: {' || repeat('"_note": {"_x": {', CAST(event_id % 4 AS INT)) || '"__slots": [' || props || ', {"_k": ' || CAST(event_id AS VARCHAR) || '}]' || repeat('}}', CAST(event_id % 4 AS INT)) || '} - all.' AS answer FROM events),
  j AS (SELECT event_id, CAST(regexp_replace(regexp_extract(answer, '\{.*\}'), '"_+(\w+)":', '"\1":', 'g') AS JSON) AS j FROM a),
  s AS (SELECT event_id, CAST(list_filter(json_extract(j, '$..slots'), lambda x: json_type(x) = 'ARRAY')[1] AS JSON[]) AS own FROM j)
SELECT event_id, CAST(i - 1 AS INT) AS slot_no, json_extract_string(own[i], '$.k') AS k FROM (SELECT event_id, own, unnest(range(1, len(own) + 1)) AS i FROM s)""")
def _(t):
    """Two slots in each answer, up to six objects deep, under keys with marks."""
    deep = (F.col("event_id") % 4).cast("int")
    answer = F.concat(F.lit("Here: {"), F.repeat(F.lit('"_note": {"_x": {'), deep), F.lit('"__slots": ['), F.col("props"), F.lit(', {"_k": '), F.col("event_id").cast("string"), F.lit("}]"), F.repeat(F.lit("}}"), deep), F.lit("} - all."))
    return t.events.select("event_id", F.posexplode(T.slots_of(answer)).alias("slot_no", "slot")).select("event_id", "slot_no", F.get_json_object("slot", "$.k").alias("k"))


@query("w2_last_turns", "SELECT account_id, turn_id FROM (SELECT *, row_number() OVER (PARTITION BY account_id ORDER BY turn_id DESC) AS rn FROM v_turns) WHERE rn <= 6")
def _(t):
    rn = F.row_number().over(Window.partitionBy("account_id").orderBy(F.desc("turn_id")))
    return t.turns.withColumn("rn", rn).filter("rn <= 6").select("account_id", "turn_id")


@query("w3_latest_ref", "SELECT account_id, arg_max(event_ref, turn_id) FILTER (WHERE event_ref IS NOT NULL) AS event_ref FROM v_turns GROUP BY account_id HAVING count(event_ref) > 0")
def _(t):
    return t.turns.filter("event_ref IS NOT NULL").groupBy("account_id").agg(F.max_by("event_ref", "turn_id").alias("event_ref"))


@query("j18_token_overlap", """
WITH s AS (SELECT DISTINCT account_id, series_id, lower(title) AS title FROM v_series), w AS (SELECT account_id, series_id, unnest(string_split(title, ' ')) AS word FROM s), q AS (SELECT account_id, unnest(string_split(max(title), ' ')) AS word FROM s GROUP BY account_id)
SELECT DISTINCT w.account_id, w.series_id FROM w JOIN q ON q.account_id = w.account_id AND q.word = w.word WHERE length(w.word) > 2""")
def _(t):
    s = t.series.select("account_id", "series_id", F.split(F.lower("title"), " ").alias("words"), F.lower("title").alias("title"))
    words = s.select("account_id", "series_id", F.explode("words").alias("word")).filter("length(word) > 2")
    asked = s.groupBy("account_id").agg(F.max("title").alias("title")).select("account_id", F.explode(F.split("title", " ")).alias("word"))
    return words.join(asked, ["account_id", "word"], "left_semi").select("account_id", "series_id").distinct()


NO_SKIP_WORDS = "['" + "', '".join(T.SKIP_WORDS) + "']"


@query("j18_skip_candidates", f"""
WITH r AS (SELECT series_id AS request_id, account_id, weekday, CASE series_id % 3 WHEN 0 THEN 'Не иду ' || upper(title) WHEN 1 THEN 'сегодня пропущу пару' ELSE 'завтра пропускаю зачёт' END AS message FROM v_series),
  p AS (SELECT r.request_id, s.series_id, list_has_any(list_filter(regexp_extract_all(replace(lower(r.message), 'ё', 'е'), '[a-zа-я0-9]+'), lambda w: NOT list_contains({NO_SKIP_WORDS}, w)), regexp_extract_all(replace(lower(s.title), 'ё', 'е'), '[a-zа-я0-9]+')) AS meant
    FROM r JOIN v_series s ON s.account_id = r.account_id AND s.weekday = r.weekday)
SELECT request_id, series_id FROM (SELECT *, bool_or(meant) OVER (PARTITION BY request_id) AS any_meant FROM p) WHERE meant OR NOT any_meant""")
def _(t):
    """Requests that name a class of their day, that name none, and that name one which isn't there."""
    n = F.col("series_id") % 3
    message = F.when(n == 0, F.concat(F.lit("Не иду "), F.upper("title"))).when(n == 1, "сегодня пропущу пару").otherwise("завтра пропускаю зачёт")
    requests = t.series.select(F.col("series_id").alias("request_id"), "account_id", "weekday", message.alias("message"))
    classes = t.series.select("account_id", "weekday", "series_id", "title")
    return slots.skip_candidates(requests, classes, ["account_id", "weekday"]).select("request_id", "series_id")


@query("j19_fuzzy_titles")
def _(t):
    """Titles of a user's events that are like the title asked for, on the same day, by a score of 0.45 at least."""
    e = t.cal_events.filter("status = 'confirmed'").select("user_id", "event_id", "title", "start_at")
    asked = e.filter("event_id % 50 = 0").select("user_id", F.col("event_id").alias("query_id"), F.col("title").alias("query"), F.col("start_at").alias("near"))
    day = lambda rows, at: rows.withColumn("day", F.to_date(at))
    pairs = day(asked, "near").join(day(e, "start_at"), ["user_id", "day"])
    scored = T.scored(pairs, "query", "title", 0.45)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "start_at", "event_id"))
    return scored.withColumn("place", place).filter("place <= 8").select("query_id", "event_id", "score", "place")


@query("t10_supersedes", f"""
WITH m AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'с ' || {DAY_SQL} || ' по ' || {DAY_SQL} WHEN 1 THEN 'экзамен ' || {DAY_SQL} ELSE 'вторая группа' END AS message FROM orders)
SELECT o_orderkey, len(regexp_extract_all(message, {DATE_SQL})) NOT IN (0, 2) OR regexp_matches(message, '(сегодня|завтра)') AS supersedes FROM m""")
def _(t):
    day = F.date_format("o_orderdate", "dd.MM.yyyy")
    message = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("с "), day, F.lit(" по "), day)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("экзамен "), day)).otherwise("вторая группа")
    return t.orders.select("o_orderkey", T.supersedes(message, F.to_date("o_orderdate")).alias("supersedes"))


@query("t17_edit_merge", """
SELECT event_id, date_trunc('day', CASE WHEN event_id % 2 = 0 THEN deadline ELSE start_at END) + (CASE WHEN event_id % 3 = 0 THEN deadline ELSE start_at END - date_trunc('day', CASE WHEN event_id % 3 = 0 THEN deadline ELSE start_at END)) AS start_at,
  date_trunc('day', CASE WHEN event_id % 2 = 0 THEN deadline ELSE start_at END) + (CASE WHEN event_id % 3 = 0 THEN deadline ELSE start_at END - date_trunc('day', CASE WHEN event_id % 3 = 0 THEN deadline ELSE start_at END)) + (deadline - start_at) AS end_at FROM v_cal_events""")
def _(t):
    m = T.merged_interval(F.col("start_at"), F.col("deadline"), F.col("deadline"), F.col("deadline"), F.col("event_id") % 2 == 0, F.col("event_id") % 3 == 0, F.lit(False))
    return t.cal_events.select("event_id", m.alias("m")).select("event_id", "m.start_at", "m.end_at")


@query("t18_transcripts", rf"""
WITH q AS (SELECT conv_id, turn, trim(regexp_replace(' «' || text || '»', '{SPACE}+', ' ', 'g')) AS text FROM conversations),
  u AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^[«"''„“]+', ''), '[»"''“”]+([.!?…]*)$', '\1')) AS text FROM q),
  n AS (SELECT *, regexp_replace(text, '{NOISE}', '', 'g') AS rest FROM u)
SELECT conv_id, turn, CASE WHEN NOT regexp_matches(text, '\p{{L}}') OR length(text) <= 60 AND rest <> text AND len(list_filter(string_split(rest, ' '), lambda w: w <> '')) <= 3 THEN ''
  ELSE regexp_replace(text, '(?i)(^|[^{WORD}])(без){SPACE}+0?(\d{{1,2}})[.:]0?(\d{{1,2}})([^{WORD}]|$)', '\1\2 \3 минут \4\5', 'g') END AS text FROM n""")
def _(t):
    return t.conversations.select("conv_id", "turn", T.transcript(F.concat(F.lit(" «"), "text", F.lit("»"))).alias("text"))
