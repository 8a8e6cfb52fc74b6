"""Core queries over the test tables, each with the DuckDB statement that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.catalog import register
from leafmill.functions import text as T
from leafmill.operators import chat as C
from leafmill.operators import messages as M
from leafmill.operators import pages as P
from leafmill.operators import reading as R
from leafmill.operators import search as S
from leafmill.operators import stores as K
from leafmill.operators import structure as O
from leafmill.sources import table
from leafmill.streaming import settle as E

_WS = " \\t\\n\\r\\f\\v   -     　﻿"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_WS}]+', ' ', 'g'))"


def _clean(x: str) -> str:
    return _trim(f"replace(replace(replace(replace({x}, '<u>', ''), '</u>', ''), '**', ''), '`', '')")


CP = "cp AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY path, page ORDER BY row_id DESC) = 1)"
FP = "fp AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY path, page ORDER BY row_id) = 1)"
MSG = "msg AS (SELECT DISTINCT ON (path, seq, id) * FROM messages WHERE path IS NOT NULL AND id <> '' AND role IN ('user', 'assistant', 'system'))"
_ARG = "json_extract_string(input, '$.{}')"
STEPS = f"""{MSG}, parts AS (SELECT path, seq, id, pos - 1 AS pos, parts[pos] AS p FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS pos FROM msg WHERE parts IS NOT NULL)),
s0 AS (SELECT path, seq, id, pos, substr(p.type, 6) AS tool, p.state AS state, p.input AS input, p.output AS output FROM parts WHERE p.type LIKE 'tool-%'),
steps AS (SELECT *, CASE tool WHEN 'search_in_document' THEN 'search' WHEN 'read_pdf_page' THEN 'read' WHEN 'read_pdf_range' THEN 'read' WHEN 'document_outline' THEN 'index' ELSE 'other' END AS bucket,
CASE tool WHEN 'read_pdf_page' THEN 'read:' || coalesce({_ARG.format("page")}, '?') WHEN 'read_pdf_range' THEN 'range:' || coalesce({_ARG.format("start")}, '?') || '-' || coalesce({_ARG.format("end")}, '?')
WHEN 'search_in_document' THEN 'search:' || coalesce({_ARG.format("query")}, '') WHEN 'document_outline' THEN 'index' ELSE 'other:' || tool END AS key,
TRY_CAST(CASE tool WHEN 'read_pdf_page' THEN {_ARG.format("page")} WHEN 'read_pdf_range' THEN {_ARG.format("start")} END AS INT) AS page FROM s0)"""


def _ranges(source: str, page: str, out: str) -> str:
    """CTE body: compressed ranges of the distinct (path, page) of `source`."""
    return f"""SELECT path, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS {out} FROM (
SELECT path, min(p) AS a, max(p) AS b FROM (SELECT path, p, p - row_number() OVER (PARTITION BY path ORDER BY p) AS g FROM (SELECT DISTINCT path, {page} AS p FROM {source} WHERE {page} IS NOT NULL)) GROUP BY path, g) GROUP BY path"""


def current(spark: SparkSession, d: str, columns: list[str] | None = None, where: str = "true") -> DataFrame:
    """The latest extraction of each page, with the columns asked for; `where` is on path and page alone, so it holds before the latest are picked."""
    cols = columns or ["text", "source"]
    return P.latest(table(spark, d, "pages").where(where).select("path", "page", "row_id", *cols), ["path", "page"], "row_id").drop("row_id")


def sized(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and flags of the latest extraction of each page; texts end at the scan."""
    return P.latest(P.sizes(table(spark, d, "pages").select("path", "page", "row_id", "text")), ["path", "page"], "row_id").drop("row_id")


def first(spark: SparkSession, d: str) -> DataFrame:
    return P.earliest(table(spark, d, "pages").select("path", "page", "row_id", "text", "source"), ["path", "page"], "row_id").drop("row_id")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return C.once(table(spark, d, "messages"))


def totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docmodels").groupBy("path").agg(F.max("total_pages").alias("total"))


_N = f"coalesce(length({_trim('text')}), 0)"


@register("survey_documents", f"""WITH {CP}, un AS ({_ranges(f"(SELECT * FROM cp WHERE {_N} < 20)", "page", "unindexed_pages")}),
dn AS ({_ranges("(SELECT * FROM cp QUALIFY row_number() OVER (PARTITION BY path ORDER BY coalesce(length(text), 0) DESC, page) <= 5)", "page", "densest_pages")}),
tb AS ({_ranges("(SELECT * FROM cp WHERE contains(text, '|---'))", "page", "table_pages")}), mk AS ({_ranges("marks", "page", "marked_pages")}),
base AS (SELECT path, count(*) AS total_pages, sum(coalesce(length(text), 0))::BIGINT AS total_chars, count(*) FILTER ({_N} < 20) AS unindexed_count FROM cp GROUP BY path)
SELECT path, total_pages, total_chars, total_chars > 6000 AS needs_chunking, unindexed_count, coalesce(unindexed_pages, '') AS unindexed_pages, coalesce(densest_pages, '') AS densest_pages, coalesce(table_pages, '') AS table_pages, coalesce(marked_pages, '') AS marked_pages
FROM base LEFT JOIN un USING (path) LEFT JOIN dn USING (path) LEFT JOIN tb USING (path) LEFT JOIN mk USING (path)""")
def survey_documents(spark: SparkSession, d: str) -> DataFrame:
    return P.survey(sized(spark, d), table(spark, d, "marks").select("path", "page"))


@register("sparse_pages", f"WITH {CP} SELECT path, page FROM cp WHERE {_N} < 20 QUALIFY row_number() OVER (PARTITION BY path ORDER BY page) <= 50")
def sparse_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.sparse(current(spark, d, ["text"]))


@register("page_flags", f"SELECT row_id, {_N} >= 20 AS indexable, coalesce(length(text), 0) < 48 AS raster_heavy, coalesce(contains(text, '|---'), false) AS \"table\" FROM pages")
def page_flags(spark: SparkSession, d: str) -> DataFrame:
    return P.flags(table(spark, d, "pages"))


@register("compress_ranges", _ranges("marks", "page", "pages"))
def compress_ranges(spark: SparkSession, d: str) -> DataFrame:
    return P.ranges(table(spark, d, "marks"))


@register("densest_pages", f"WITH {CP} SELECT path, page, coalesce(length(text), 0)::INT AS chars FROM cp QUALIFY row_number() OVER (PARTITION BY path ORDER BY chars DESC, page) <= 5")
def densest_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.densest(sized(spark, d))


@register("page_merge_reload", f"""WITH {FP}, {CP}, j AS (SELECT coalesce(a.path, b.path) AS path, coalesce(a.page, b.page) AS page, coalesce(a.text, '') AS et, coalesce(b.text, '') AS it, a.source AS es, b.source AS src FROM fp a FULL JOIN cp b ON a.path = b.path AND a.page = b.page),
n AS (SELECT *, length({_trim("et")}) AS n, length({_trim("it")}) AS m FROM j),
w AS (SELECT *, CASE WHEN (coalesce(es = 'vision', false) AND n >= 20) <> (coalesce(src = 'vision', false) AND m >= 20) THEN coalesce(src = 'vision', false) AND m >= 20
WHEN n >= 20 AND m < 20 THEN false WHEN m >= 20 AND n < 20 THEN true WHEN n >= 20 AND m >= 20 THEN m > n * 1.25 ELSE m >= n END AS wins FROM n)
SELECT path, page, CASE WHEN wins THEN it ELSE et END AS text, CASE WHEN NOT wins OR it = et THEN es ELSE src END AS source FROM w""")
def page_merge_reload(spark: SparkSession, d: str) -> DataFrame:
    return P.merge_reload(first(spark, d), current(spark, d))


@register("pages_changed", f"WITH {FP}, {CP} SELECT path, bool_or(a.has IS DISTINCT FROM b.has OR a.t <> b.t) AS changed FROM (SELECT path, page, true AS has, coalesce(text, '') AS t FROM fp WHERE page % 7 <> 3) a FULL JOIN (SELECT path, page, true AS has, coalesce(text, '') AS t FROM cp WHERE page % 11 <> 5) b USING (path, page) GROUP BY path")
def pages_changed(spark: SparkSession, d: str) -> DataFrame:
    """First against latest extractions; each side lacks other pages, so some are added and some gone."""
    return P.changed(first(spark, d).where("page % 7 <> 3"), current(spark, d).where("page % 11 <> 5"))


_LIVE = f"l AS (SELECT path, page, text, list_filter(string_split(text, chr(10)), lambda x: length({_trim('x')}) > 0) AS live FROM cp WHERE text IS NOT NULL)"
_EDGES = f"""e AS (SELECT path, 'first' AS pos, live[1] AS line FROM l WHERE len(live) >= 3 UNION ALL SELECT path, 'last', live[-1] FROM l WHERE len(live) >= 3),
k AS (SELECT path, pos, key, count(*) AS pages FROM (SELECT path, pos, lower({_clean("line")}) AS key FROM e WHERE NOT regexp_matches(line, '^[ \\t]*[#|]')) WHERE length(key) BETWEEN 1 AND 80 GROUP BY ALL HAVING count(*) >= 3)"""


@register("running_line_keys", f"WITH {CP}, {_LIVE}, {_EDGES} SELECT path, pos, key, pages FROM k")
def running_line_keys(spark: SparkSession, d: str) -> DataFrame:
    return P.running_keys(current(spark, d, ["text"]))


@register("strip_running_lines", f"""WITH {CP}, {_LIVE}, {_EDGES},
a AS (SELECT path, page, text, string_split(text, chr(10)) AS ls FROM cp),
b AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: length({_trim("ls[i]")}) > 0) AS nz FROM a),
c AS (SELECT *, CASE WHEN len(nz) >= 3 AND NOT regexp_matches(ls[nz[1]], '^[ \\t]*[#|]') THEN lower({_clean("ls[nz[1]]")}) END AS hk, CASE WHEN len(nz) >= 3 AND NOT regexp_matches(ls[nz[-1]], '^[ \\t]*[#|]') THEN lower({_clean("ls[nz[-1]]")}) END AS fk FROM b),
d AS (SELECT c.*, x.key IS NOT NULL AS h, y.key IS NOT NULL AS f FROM c LEFT JOIN k x ON x.path = c.path AND x.pos = 'first' AND x.key = c.hk LEFT JOIN k y ON y.path = c.path AND y.pos = 'last' AND y.key = c.fk)
SELECT path, page, CASE WHEN h OR f THEN {_trim("array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT ((h AND i = nz[1]) OR (f AND i = nz[-1]))), lambda i: ls[i]), chr(10))")} ELSE text END AS text FROM d""")
def strip_running_lines(spark: SparkSession, d: str) -> DataFrame:
    return P.strip_running(current(spark, d, ["text"]))


_TOKEN = "regexp_extract(title, '^[^ \\t]+')"
SYN = f"""hl AS (SELECT path, page, i, string_split(text, chr(10))[i] AS raw FROM (SELECT path, page, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM cp WHERE contains(text, '#'))),
hh AS (SELECT path, page, i, length(regexp_extract(raw, '^[ \\t]*(#+)', 1)) AS level, {_clean("regexp_replace(raw, '^[ \\t]*#+', '')")} AS title FROM hl),
hp AS (SELECT * FROM hh WHERE level BETWEEN 1 AND 2 AND length(title) BETWEEN 2 AND 120 AND regexp_matches(title, '^[\\p{{L}}\\p{{N}}]') AND regexp_matches(title, '\\p{{L}}')
AND (level = 1 OR regexp_matches({_TOKEN}, '^[0-9][0-9.]*$') OR (NOT regexp_matches(title, '[:=]') AND title NOT LIKE '%.' AND length(title) <= 80))),
hk AS (SELECT * FROM (SELECT *, lag(title) OVER (PARTITION BY path ORDER BY page, i) AS b FROM hp) WHERE b IS NULL OR b <> title),
syn AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY page, i) - 1)::INT AS ord, title, page, level::INT AS level FROM hk QUALIFY ord < 1000)"""


@register("synthesize_outline", f"WITH {CP}, {SYN} SELECT * FROM syn")
def synthesize_outline(spark: SparkSession, d: str) -> DataFrame:
    return O.synthesize(current(spark, d, ["text"]))


_TOT = "tot AS (SELECT path, max(total_pages) AS total FROM docmodels GROUP BY path)"
_USE = f"us AS (SELECT o.path, ord, title, page, level, coalesce(total, 0) AS total FROM outline o LEFT JOIN tot USING (path) WHERE length({_trim('title')}) > 0 AND page >= 1 AND (coalesce(total, 0) <= 0 OR page <= total))"


def usable(spark: SparkSession, d: str) -> DataFrame:
    return O.usable(table(spark, d, "outline"), totals(spark, d))


@register("usable_outline", f"WITH {_TOT}, {_USE} SELECT path, ord, title, page, level FROM us")
def usable_outline(spark: SparkSession, d: str) -> DataFrame:
    return usable(spark, d).drop("total")


@register("resolved_outline", f"WITH {CP}, {SYN}, {_TOT}, {_USE} SELECT path, ord, title, page, level FROM us UNION ALL SELECT * FROM syn WHERE path NOT IN (SELECT path FROM us)")
def resolved_outline(spark: SparkSession, d: str) -> DataFrame:
    return O.preferred(usable(spark, d), O.synthesize(current(spark, d, ["text"])))


@register("section_ranges", f"""WITH {_TOT}, {_USE}, e AS (SELECT *, (SELECT arg_min(b.page, b.ord) FROM us b WHERE b.path = a.path AND b.ord > a.ord AND b.level <= a.level) AS nxt FROM us a)
SELECT path, ord, title, page AS start_page, CASE WHEN total > 0 THEN greatest(page, least(CASE WHEN nxt IS NULL THEN total ELSE greatest(page, nxt - 1) END, total)) ELSE page END AS end_page FROM e""")
def section_ranges(spark: SparkSession, d: str) -> DataFrame:
    return O.section_ranges(usable(spark, d))


@register("active_heading", f"""WITH {CP}, {_TOT}, {_USE} SELECT path, page, h.ord AS ord, h.title AS title FROM (
SELECT c.path, c.page, (SELECT arg_max({{'ord': u.ord, 'title': u.title}}, u.ord) FROM us u WHERE u.path = c.path AND u.ord < coalesce((SELECT min(x.ord) FROM us x WHERE x.path = c.path AND x.page > c.page), 1000000)) AS h FROM cp c)""")
def active_heading(spark: SparkSession, d: str) -> DataFrame:
    return O.active_heading(current(spark, d, ["text"]), usable(spark, d))


@register("find_section", f"""WITH {_TOT}, {_USE}, t AS (SELECT *, lower({_trim("title")}) AS t FROM us)
SELECT path, arg_min(ord, {{'a': (t <> 'annex')::INT, 'b': CASE WHEN t = 'annex' THEN 0 ELSE length(title) END, 'c': ord}}) AS ord FROM t WHERE contains(t, 'annex') OR contains('annex', t) GROUP BY path""")
def find_section(spark: SparkSession, d: str) -> DataFrame:
    return O.find_section(usable(spark, d), " Annex ")


_ROW = f"""CASE WHEN starts_with({_trim("x")}, '|') THEN (CASE WHEN len(list_filter(string_split(CASE WHEN {_trim("x")} LIKE '%|' AND length({_trim("x")}) > 1 THEN {_trim("x")}[2:-2] ELSE {_trim("x")}[2:] END, '|'), lambda c: NOT regexp_matches(c, '^[ \\t]*:?-+:?[ \\t]*$'))) = 0 THEN NULL
ELSE nullif(array_to_string(list_transform(string_split(CASE WHEN {_trim("x")} LIKE '%|' AND length({_trim("x")}) > 1 THEN {_trim("x")}[2:-2] ELSE {_trim("x")}[2:] END, '|'), lambda c: {_trim("c")}), ' '), '') END)
ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
'^[ \\t]{{0,3}}#{{1,6}}[ \\t]+', ''), '^[ \\t]{{0,3}}[-*+][ \\t]+', ''), '^[ \\t]{{0,3}}>[ \\t]?', ''), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '(^|\\W)\\*(\\S(?:.*?\\S)?)\\*(\\W|$)', '\\1\\2\\3', 'g'), '`([^`]*)`', '\\1', 'g'), '</?u>', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') END"""
PLAIN = f"pl AS (SELECT path, page, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_ROW}), lambda y: y IS NOT NULL), chr(10)) AS plain FROM cp WHERE text IS NOT NULL)"


@register("markdown_plain", f"WITH {CP}, {PLAIN} SELECT * FROM pl")
def markdown_plain(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, ["text"]).where("text is not null").select("path", "page", T.plain_text(F.col("text")).alias("plain"))


_Q = "calibration"
HITS = f"""{CP}, {PLAIN}, np AS (SELECT path, page, nfc_normalize(plain) AS plain FROM pl), sp AS (SELECT path, page, plain, string_split(lower(plain), '{_Q}') AS ps FROM np WHERE contains(lower(plain), '{_Q}')),
ix AS (SELECT path, page, plain, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + (i - 1) * {len(_Q)})::INT AS idx FROM (SELECT *, unnest(range(1, len(ps))) AS i FROM sp)),
hits AS (SELECT path, page, idx, plain[idx + 1 : idx + {len(_Q)}] AS match, (CASE WHEN idx > 80 THEN '…' ELSE '' END) || {_collapse(f"plain[greatest(0, idx - 80) + 1 : idx + {len(_Q)} + 80]")} AS snippet FROM ix)"""


@register("search_hits", f"WITH {HITS} SELECT * FROM hits")
def search_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.hits(current(spark, d, ["text"]), _Q)


@register("search_count", f"WITH {HITS} SELECT path, count(*) AS hits, count(DISTINCT page) AS pages FROM hits GROUP BY path")
def search_count(spark: SparkSession, d: str) -> DataFrame:
    return S.count_hits(current(spark, d, ["text"]), _Q)


@register("search_topn_truncated", f"""WITH {HITS} SELECT path, rn::INT AS rn, page, idx, match, snippet, n > 12 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page, idx) AS rn, count(*) OVER (PARTITION BY path) AS n FROM hits) WHERE rn <= 12""")
def search_topn_truncated(spark: SparkSession, d: str) -> DataFrame:
    return S.top_hits(current(spark, d, ["text"]), _Q)


_VIS = "coalesce(array_to_string(list_transform(list_filter(parts, lambda p: p.type = 'text'), lambda p: p.text), chr(10)), '')"


@register("message_search", f"""WITH {MSG}, v AS (SELECT path, seq, id, {_VIS} AS t FROM msg), f AS (SELECT *, strpos(lower(t), 'notice') - 1 AS idx FROM v WHERE contains(lower(t), 'notice'))
SELECT path, seq, id, idx::INT AS idx, (CASE WHEN idx > 30 THEN '…' ELSE '' END) || {_trim("t[greatest(0, idx - 30) + 1 : least(length(t), idx + 66)]")} || (CASE WHEN least(length(t), idx + 66) < length(t) THEN '…' ELSE '' END) AS excerpt FROM f""")
def message_search(spark: SparkSession, d: str) -> DataFrame:
    return S.message_hits(messages(spark, d), "notice")


@register("search_accents", "WITH " + HITS.replace(_Q, "préavis").replace(str(len(_Q)), str(len("préavis"))) + " SELECT path, page, idx, match, snippet FROM hits")
def search_accents(spark: SparkSession, d: str) -> DataFrame:
    return S.hits(current(spark, d, ["text"]), "Préavis")


@register("search_preview", f"""WITH {HITS}, b AS (SELECT *, {_collapse("snippet")} AS raw, row_number() OVER (PARTITION BY path ORDER BY page, idx) AS rn FROM hits),
t AS (SELECT path, string_agg('p.' || page || ': ' || raw[1:48] || CASE WHEN length(raw) > 48 THEN '…' ELSE '' END, '; ' ORDER BY rn) AS snippets FROM b WHERE rn <= 2 GROUP BY path)
SELECT path, n AS pages, snippets, 'Matches on ' || n || ' page(s) — ' || snippets AS message FROM t JOIN (SELECT path, count(DISTINCT page) AS n FROM hits GROUP BY path) USING (path)""")
def search_preview(spark: SparkSession, d: str) -> DataFrame:
    return S.preview(S.hits(current(spark, d, ["text"]), _Q))


@register("search_unindexed", f"""WITH {HITS}, un AS ({_ranges(f"(SELECT * FROM cp WHERE {_N} < 20)", "page", "unindexed_pages")}), c AS (SELECT path, count(*) AS n FROM cp WHERE {_N} < 20 GROUP BY path)
SELECT path, page, idx, coalesce(n, 0) AS unindexed_count, coalesce(unindexed_pages, '') AS unindexed_pages FROM hits LEFT JOIN c USING (path) LEFT JOIN un USING (path)""")
def search_unindexed(spark: SparkSession, d: str) -> DataFrame:
    pages = current(spark, d, ["text"])
    return S.with_unindexed(S.hits(pages, _Q).select("path", "page", "idx"), pages)


@register("read_page_slice", f"""WITH {CP}, t AS (SELECT path, page, coalesce(text, '') AS t FROM cp), o AS (SELECT path, page, t, unnest(range(0, greatest(length(t), 1), 6000)) AS o FROM t)
SELECT path, page, o::INT AS "offset", t[o + 1 : o + 6000] AS text, length(t[o + 1 : o + 6000])::INT AS chars, length(t) > o + 6000 AS truncated, (CASE WHEN length(t) > o + 6000 THEN o + 6000 END)::INT AS next_offset FROM o""")
def read_page_slice(spark: SparkSession, d: str) -> DataFrame:
    return R.page_slices(current(spark, d, ["text"]))


def _read(asked: str, most: int, known: str = "false", used: int = 0, budget: int = 200_000, scans: int | None = None) -> str:
    """CTEs that walk the pages of `asked` (path, a, b, o) by the rule of reading, one page after the other."""
    mark = len(R.ALREADY_READ)
    skip = "false" if scans is None else f"(blank AND sum(blank::INT) OVER (PARTITION BY path ORDER BY page) > {scans})"
    return f"""asked AS ({asked}), r0 AS (SELECT c.path, c.page, coalesce(text, '') AS t, {_N} < 20 AS blank, a, o, ({known}) AS known FROM cp c JOIN asked USING (path) WHERE page BETWEEN a AND b),
r1 AS (SELECT *, {skip} AS skip, CASE WHEN page = a THEN least(o, length(t)) ELSE 0 END AS sh FROM r0),
r2 AS (SELECT *, substr(t, sh + 1) AS rest, known AND sh = 0 AS seen, '--- Page ' || page || CASE WHEN sh > 0 THEN ' (cont.)' ELSE '' END || ' ---' || chr(10) AS head, sum((NOT skip)::INT) OVER (PARTITION BY path ORDER BY page) > 1 AS later FROM r1),
r3 AS (SELECT *, CASE WHEN skip THEN 0 ELSE length(head) + CASE WHEN later THEN 2 ELSE 0 END END AS frame, CASE WHEN skip THEN 0 WHEN seen THEN {mark} ELSE length(rest) END AS body, CASE WHEN skip OR seen THEN 0 ELSE length(rest) END AS cost FROM r2),
r4 AS (SELECT *, coalesce(sum(frame + body) OVER w, 0) AS far, {used} + coalesce(sum(cost) OVER w, 0) AS spent FROM r3 WINDOW w AS (PARTITION BY path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r5 AS (SELECT *, least({most} - far, {budget} - spent) - frame AS room, {budget} - spent <= {most} - far AS tight FROM r4),
r6 AS (SELECT *, spent >= {budget} OR (NOT skip AND (room <= 0 OR length(rest) > room)) AS ends FROM r5),
r7 AS (SELECT *, min(page) FILTER (ends) OVER (PARTITION BY path) AS stop FROM r6),
r8 AS (SELECT *, head || CASE WHEN ends THEN rest[1:room] WHEN seen THEN '{R.ALREADY_READ}' ELSE rest END AS x FROM r7 WHERE NOT skip AND (stop IS NULL OR page < stop OR (page = stop AND spent < {budget} AND room > 0))),
got AS (SELECT path, string_agg(x, chr(10) || chr(10) ORDER BY page) AS text, max(page) AS end_page, sum(frame - length(head) + length(x)) AS chars, sum(CASE WHEN seen AND NOT ends THEN 0 ELSE length(x) - length(head) END) AS charged, string_agg(CASE WHEN NOT seen OR ends THEN page::VARCHAR END, ',' ORDER BY page) AS pages FROM r8 GROUP BY path),
fin AS (SELECT path, page AS next_page, CASE WHEN spent >= {budget} THEN CASE WHEN page = a THEN o ELSE 0 END WHEN room <= 0 THEN sh ELSE sh + room END AS next_offset, spent >= {budget} OR tight AS budget_exceeded FROM r7 WHERE page = stop),
sk AS ({_ranges(f"(SELECT * FROM r7 WHERE skip AND (stop IS NULL OR page < stop))", "page", "unscanned")}),
res AS (SELECT path, coalesce(text, '') AS text, coalesce(chars, 0)::BIGINT AS char_count, coalesce(charged, 0)::BIGINT AS charged, end_page, next_page, next_offset::INT AS next_offset, next_page IS NOT NULL AS truncated, coalesce(budget_exceeded, false) AS budget_exceeded, coalesce(unscanned, '') AS unscanned, coalesce(pages, '') AS pages
FROM (SELECT DISTINCT path FROM asked) LEFT JOIN got USING (path) LEFT JOIN fin USING (path) LEFT JOIN sk USING (path))"""


def _all_paths(a: int, b: int, o: int = 0) -> str:
    return f"SELECT DISTINCT path, {a} AS a, {b} AS b, {o} AS o FROM cp WHERE path IS NOT NULL"


def _asked(spark: SparkSession, d: str, a: int, b: int, offset: int = 0) -> DataFrame:
    """The same range asked of every path."""
    paths = table(spark, d, "pages").select("path").where("path is not null").distinct()
    return paths.select("path", F.lit(a).alias("first_page"), F.lit(b).alias("last_page"), F.lit(offset).alias("offset"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("pages", F.array_join("pages", ","))


@register("read_range_budget", f"WITH {CP}, {_read(_all_paths(1, 6), 3000)} SELECT * FROM res")
def read_range_budget(spark: SparkSession, d: str) -> DataFrame:
    pages = current(spark, d, ["text"], "page between 1 and 6")
    return _shown(R.read_ranges(pages, _asked(spark, d, 1, 6), 3000))


@register("read_range_resume", f"WITH {CP}, {_read(_all_paths(2, 9, 700), 4000, used=1000, budget=4500)} SELECT * FROM res")
def read_range_resume(spark: SparkSession, d: str) -> DataFrame:
    """Pages 2 to 9 from an offset, with part of the run's budget spent."""
    return _shown(R.read_ranges(current(spark, d, ["text"], "page between 2 and 9"), _asked(spark, d, 2, 9, 700), 4000, used=1000, budget=4500))


@register("read_range_delivered", f"WITH {CP}, {_read(_all_paths(1, 8), 5000, 'page % 3 = 1', scans=1)} SELECT * FROM res")
def read_range_delivered(spark: SparkSession, d: str) -> DataFrame:
    """Every third page was delivered before, and one page may be scanned."""
    pages = current(spark, d, ["text"], "page between 1 and 8")
    known = table(spark, d, "pages").where("page % 3 = 1 and page <= 8").select("path", "page").distinct()
    return _shown(R.read_ranges(pages, _asked(spark, d, 1, 8), 5000, delivered=known, scans=1))


@register("read_section", f"""WITH {CP}, {_TOT}, {_USE}, e AS (SELECT *, (SELECT arg_min(b.page, b.ord) FROM us b WHERE b.path = a.path AND b.ord > a.ord AND b.level <= a.level) AS nxt FROM us a),
se AS (SELECT path, ord, title, page AS a, CASE WHEN total > 0 THEN greatest(page, least(CASE WHEN nxt IS NULL THEN total ELSE greatest(page, nxt - 1) END, total)) ELSE page END AS b FROM e),
ti AS (SELECT *, lower({_trim("title")}) AS t FROM us), pick AS (SELECT path, arg_min(ord, {{'a': (t <> 'annex')::INT, 'b': CASE WHEN t = 'annex' THEN 0 ELSE length(title) END, 'c': ord}}) AS ord FROM ti WHERE contains(t, 'annex') OR contains('annex', t) GROUP BY path),
{_read("SELECT path, a, b, 0 AS o FROM se JOIN pick USING (path, ord)", 6000)} SELECT res.*, title AS section FROM res JOIN pick USING (path) JOIN se USING (path, ord)""")
def read_section(spark: SparkSession, d: str) -> DataFrame:
    return _shown(R.read_section(current(spark, d, ["text"]), usable(spark, d), "Annex"))


@register("evict_greedy_budget", f"""WITH RECURSIVE {CP}, z AS (SELECT path, string_split(path, '/')[3] AS folder, sum(coalesce(length(text), 0))::BIGINT AS size, max(row_id) AS saved FROM pages GROUP BY path),
o AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY saved DESC, path) AS rn FROM z),
w AS (SELECT folder, 1 AS rn, (size <= 60000)::INT::BIGINT AS n, CASE WHEN size <= 60000 THEN size ELSE 0 END AS c, CASE WHEN size <= 60000 THEN path END AS path FROM o WHERE rn = 1
UNION ALL SELECT o.folder, o.rn, w.n + (w.n < 12 AND w.c + o.size <= 60000)::INT, CASE WHEN w.n < 12 AND w.c + o.size <= 60000 THEN w.c + o.size ELSE w.c END, CASE WHEN w.n < 12 AND w.c + o.size <= 60000 THEN o.path END FROM w JOIN o ON o.folder = w.folder AND o.rn = w.rn + 1)
SELECT folder, path FROM w WHERE path IS NOT NULL""")
def evict_greedy_budget(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "pages").groupBy("path").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("size"), F.max("row_id").alias("saved"))
    return R.evict_greedy(sizes.withColumn("folder", F.element_at(F.split("path", "/"), 3)), "folder", "path", "size", "saved", 12, 60000)


FND = "fnd AS (SELECT DISTINCT ON (path, id) * FROM findings)"
ACT = "act AS (SELECT * FROM fnd f WHERE NOT coalesce(struck, false) AND NOT EXISTS (FROM fnd g WHERE g.path = f.path AND g.supersedes = f.id))"


def findings(spark: SparkSession, d: str) -> DataFrame:
    return K.findings_once(table(spark, d, "findings"))


@register("active_findings", f"WITH {FND}, {ACT} SELECT path, id, claim, created_at FROM act")
def active_findings(spark: SparkSession, d: str) -> DataFrame:
    return K.active(findings(spark, d)).select("path", "id", "claim", "created_at")


@register("prefix_budget_newest", f"WITH {FND}, {ACT} SELECT path, id FROM act QUALIFY sum(least(length(claim), 300)) OVER (PARTITION BY path ORDER BY created_at DESC, id ROWS UNBOUNDED PRECEDING) <= 400")
def prefix_budget_newest(spark: SparkSession, d: str) -> DataFrame:
    return R.keep_prefix(K.active(findings(spark, d)), "path", [F.desc("created_at"), F.col("id")], F.least(F.length("claim"), F.lit(300)), 400).select("path", "id")


@register("normalize_pages", f"WITH {FND} SELECT path, id, array_to_string(list_sort(list_distinct(list_filter(coalesce(pages, []), lambda p: p >= 1)))[1:20], ',') AS pages FROM fnd")
def normalize_pages(spark: SparkSession, d: str) -> DataFrame:
    return findings(spark, d).select("path", "id", F.array_join(K.normal_pages(), ",").alias("pages"))


@register("finding_page_ranges", f"WITH {FND} {_ranges('(SELECT path, unnest(pages) AS page FROM fnd)', 'page', 'pages')}")
def finding_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return P.ranges(findings(spark, d).select("path", F.explode("pages").alias("page")))


@register("stale_findings", f"WITH {FND}, cur AS (SELECT path, max(stamp) AS now FROM docmodels GROUP BY path) SELECT path, bool_or(now <> '' AND stamp <> now) AS stale FROM fnd JOIN cur USING (path) GROUP BY path")
def stale_findings(spark: SparkSession, d: str) -> DataFrame:
    return K.stale(findings(spark, d), table(spark, d, "docmodels").groupBy("path").agg(F.max("stamp").alias("now")))


@register("record_filter", f"WITH {FND} SELECT path, id FROM fnd WHERE contains(lower(concat_ws(chr(10), claim, evidence, why)), 'notice period')")
def record_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.filter_rows(findings(spark, d), ["claim", "evidence", "why"], " Notice period ").select("path", "id")


@register("record_new_findings", f"""WITH {FND}, nw AS (SELECT path, 'n_' || id AS id, list_sort(list_distinct(list_filter(coalesce(pages, []), lambda p: p >= 1)))[1:20] AS pages, {_trim("claim")}[1:500] AS claim, CASE WHEN struck THEN id END AS supersedes FROM fnd),
st AS (SELECT DISTINCT path, supersedes FROM fnd WHERE supersedes IS NOT NULL)
SELECT n.path, n.id, claim FROM nw n WHERE len(pages) > 0 AND length(claim) > 0 AND (supersedes IS NULL OR NOT EXISTS (FROM st WHERE st.path = n.path AND st.supersedes = n.supersedes))""")
def record_new_findings(spark: SparkSession, d: str) -> DataFrame:
    store = findings(spark, d)
    new = store.select("path", F.concat(F.lit("n_"), "id").alias("id"), "pages", "claim", F.when(F.col("struck"), F.col("id")).alias("supersedes"), "created_at")
    return K.add_findings(store, new).select("path", "id", "claim")


@register("marks_sanitized", """SELECT path, row_number() OVER (PARTITION BY path ORDER BY page, created_at, row_id)::INT AS pos, id, page, text[1:500] AS text, note[1:2000] AS note, coalesce(kind, 'text') AS kind
FROM (SELECT * FROM marks WHERE path IS NOT NULL AND id <> '' AND page >= 1 AND len(rects) > 0 AND (kind IS NULL OR kind = 'region') QUALIFY row_number() OVER (PARTITION BY path, id ORDER BY row_id) = 1) QUALIFY pos <= 2000""")
def marks_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return K.sanitize_marks(table(spark, d, "marks"))


@register("mru_recents", "SELECT path, max(created_at) AS opened_at FROM marks GROUP BY path ORDER BY opened_at DESC, path LIMIT 10")
def mru_recents(spark: SparkSession, d: str) -> DataFrame:
    return K.recents(table(spark, d, "marks").select("path", F.col("created_at").alias("opened_at")))


@register("chat_prune_oldest", """WITH c AS (SELECT path, min(arrived_at) AS inserted FROM messages GROUP BY path), k AS (SELECT path FROM marks GROUP BY path ORDER BY max(created_at) DESC, path LIMIT 10)
SELECT path, inserted FROM c WHERE path NOT IN (SELECT path FROM c WHERE path NOT IN (SELECT path FROM k) ORDER BY inserted, path LIMIT greatest(0, (SELECT count(*) FROM c) - 100))""")
def chat_prune_oldest(spark: SparkSession, d: str) -> DataFrame:
    return K.prune_chats(table(spark, d, "messages").groupBy("path").agg(F.min("arrived_at").alias("inserted")), mru_recents(spark, d))


@register("doc_export_markdown", f"""WITH {CP}, m AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page, created_at, id, row_id) AS pos FROM (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY path, id ORDER BY row_id) = 1)),
h AS (SELECT path, min(name) AS name, max(title) AS title FROM docmodels GROUP BY path), hh AS (SELECT path, name, nullif({_trim("coalesce(title, '')")}, '') AS title FROM h)
SELECT path, 0 AS part, 0::BIGINT AS ord, '# ' || coalesce(title, name) || CASE WHEN title <> name THEN chr(10) || chr(10) || '**Source:** ' || name ELSE '' END AS block FROM hh
UNION ALL SELECT path, 1, pos, CASE WHEN pos = 1 THEN '## Marks' || chr(10) || chr(10) ELSE '' END || '- **p. ' || page || '** — ' || coalesce(nullif(text, ''), '(no text)') || CASE WHEN length(note) > 0 THEN chr(10) || '  - ' || note ELSE '' END FROM m
UNION ALL SELECT path, 2, page, '<!-- page ' || page || ' -->' || chr(10) || chr(10) || {_trim('text')} FROM cp WHERE length({_trim('text')}) > 0""")
def doc_export_markdown(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docmodels").groupBy("path").agg(F.min("name").alias("name"), F.max("title").alias("title"))
    return K.export_blocks(current(spark, d, ["text"]), docs, marks_once(spark, d))


def marks_once(spark: SparkSession, d: str) -> DataFrame:
    """Each mark as it was delivered first."""
    return P.earliest(table(spark, d, "marks"), ["path", "id"], "row_id")


MK = "mk1 AS (SELECT * FROM marks QUALIFY row_number() OVER (PARTITION BY path, id ORDER BY row_id) = 1)"


@register("cache_stats", f"WITH {CP} SELECT count(DISTINCT path) AS docs, count(*) AS pages, sum(coalesce(length(text), 0))::BIGINT AS chars FROM cp")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    return K.cache_totals(sized(spark, d))


@register("fresh_cache_join", f"WITH {CP}, cur AS (SELECT DISTINCT path, stamp FROM docmodels) SELECT path, page FROM cp SEMI JOIN cur USING (path, stamp) WHERE source = 'vision'")
def fresh_cache_join(spark: SparkSession, d: str) -> DataFrame:
    return current(spark, d, ["source", "stamp"]).where("source = 'vision'").join(table(spark, d, "docmodels").select("path", "stamp"), ["path", "stamp"], "left_semi").select("path", "page")


@register("history_window", f"""WITH {MSG}, t AS (SELECT path, seq, id, sum((role = 'user')::INT) OVER (PARTITION BY path ORDER BY seq, id ROWS UNBOUNDED PRECEDING)::BIGINT AS turn, sum((role = 'user')::INT) OVER (PARTITION BY path) AS total FROM msg)
SELECT path, seq, id, turn, (CASE WHEN total <= 4 THEN 0 ELSE floor((total - 4) / 2) * 2 END)::BIGINT AS dropped FROM t WHERE turn > dropped""")
def history_window(spark: SparkSession, d: str) -> DataFrame:
    return C.history_window(messages(spark, d), 4, 2)


@register("turn_count", f"WITH {MSG} SELECT path, count(*) FILTER (role = 'user') AS turns FROM msg GROUP BY path")
def turn_count(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).groupBy("path").agg(F.count_if(F.col("role") == "user").alias("turns"))


@register("tool_step_buckets", f"WITH {STEPS} SELECT path, count(*) FILTER (bucket = 'search') AS search, count(*) FILTER (bucket = 'read') AS \"read\", count(*) FILTER (bucket = 'index') AS \"index\", count(*) FILTER (bucket = 'other') AS other FROM steps GROUP BY path")
def tool_step_buckets(spark: SparkSession, d: str) -> DataFrame:
    return C.bucket_counts(C.tool_steps(messages(spark, d)))


@register("tool_step_details", f"WITH {STEPS} SELECT path, key, n, label, page, row_number() OVER (PARTITION BY path ORDER BY f)::INT AS ord FROM (SELECT path, key, count(*) AS n, arg_min(CASE WHEN tool = 'read_pdf_page' THEN 'Read page ' || regexp_extract(key, ':(.*)$', 1) WHEN tool = 'read_pdf_range' THEN 'Read pages ' || regexp_extract(key, ':(.*)$', 1) WHEN bucket = 'search' THEN 'Search ' || regexp_extract(key, ':(.*)$', 1) WHEN bucket = 'index' THEN 'Survey' ELSE tool END, seq * 1000 + pos) AS label, arg_min(page, seq * 1000 + pos) AS page, min(seq * 1000 + pos) AS f FROM steps GROUP BY path, key)")
def tool_step_details(spark: SparkSession, d: str) -> DataFrame:
    return C.step_details(C.tool_steps(messages(spark, d)))


@register("run_plan_phases", f"""WITH {STEPS}, c AS (SELECT path, count(*) FILTER (bucket = 'index') AS a, count(*) FILTER (bucket = 'search') AS b, count(*) FILTER (bucket IN ('read', 'other')) AS r FROM steps GROUP BY path)
SELECT path, 0 AS ord, 'survey' AS phase, a AS steps, 'done' AS state FROM c UNION ALL SELECT path, 1, 'locate', b, 'done' FROM c UNION ALL SELECT path, 2, 'read', r, 'done' FROM c UNION ALL SELECT path, 3, 'answer', 0, 'done' FROM c""")
def run_plan_phases(spark: SparkSession, d: str) -> DataFrame:
    return C.run_plan(C.tool_steps(messages(spark, d)))


@register("usage_totals", f"""WITH {MSG}, u AS (SELECT path, metadata.input_tokens AS i, metadata.output_tokens AS o, greatest(0, metadata.finished_at - metadata.started_at) AS ms, metadata.finished_at IS NOT NULL AND metadata.started_at IS NOT NULL AS timed FROM msg),
t AS (SELECT path, sum(coalesce(i, 0))::BIGINT AS input_tokens, sum(coalesce(o, 0))::BIGINT AS output_tokens, sum(CASE WHEN timed THEN ms ELSE 0 END)::BIGINT AS duration_ms, sum(CASE WHEN timed AND ms > 0 THEN o END) AS tt FROM u GROUP BY path)
SELECT path, input_tokens, output_tokens, duration_ms, CASE WHEN tt > 0 AND duration_ms > 0 THEN round(tt::DOUBLE * 1000.0 / duration_ms::DOUBLE, 1) END AS tokens_per_s FROM t""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    return C.usage_totals(messages(spark, d))


@register("step_durations", f"""WITH {MSG}, g AS (SELECT path, seq, id, metadata.finished_at - CASE WHEN row_number() OVER w = 1 THEN metadata.started_at ELSE lag(metadata.finished_at) OVER w END AS gap FROM msg WHERE role = 'assistant' WINDOW w AS (PARTITION BY path ORDER BY seq, id))
SELECT path, seq, id, (CASE WHEN gap IS NOT NULL THEN greatest(0, gap) END)::BIGINT AS gap_ms FROM g""")
def step_durations(spark: SparkSession, d: str) -> DataFrame:
    return C.message_gaps(messages(spark, d)).select("path", "seq", "id", F.col("gap_ms").cast("bigint").alias("gap_ms"))


_TL = "coalesce(length(json_extract_string(output, '$.text')), TRY_CAST(json_extract_string(output, '$.charCount') AS INT), length(output), 0)"


_LINE = f"""CASE WHEN output LIKE '% — omitted from chat history]' OR output = '[cancelled]' OR coalesce(CASE WHEN json_valid(output) THEN json_extract_string(output, '$.budgetExceeded') END = 'true', false) THEN output
WHEN tool = 'read_pdf_page' AND {_ARG.format("page")} IS NOT NULL THEN '[Read page ' || {_ARG.format("page")} || ', ' || {_TL} || ' chars — omitted from chat history]'
WHEN tool = 'read_pdf_range' THEN '[Read ' || CASE WHEN {_ARG.format("start")} IS NULL OR {_ARG.format("end")} IS NULL THEN 'page range' WHEN {_ARG.format("start")} = {_ARG.format("end")} THEN 'page ' || {_ARG.format("start")} ELSE 'pages ' || {_ARG.format("start")} || '–' || {_ARG.format("end")} END || ', ' || {_TL} || ' chars — omitted from chat history]'
WHEN tool = 'search_in_document' THEN '[Search "' || coalesce({_ARG.format("query")}, 'query')[1:40] || '", ' || coalesce(CASE WHEN json_type(output, '$.hits') = 'ARRAY' THEN json_array_length(output, '$.hits') WHEN json_valid(output) AND json_type(output) = 'ARRAY' THEN json_array_length(output) END, {_TL}) || ' hits — omitted from chat history]'
WHEN tool = 'read_section' THEN '[Read section "' || coalesce({_ARG.format("title")}, 'section')[1:60] || '", ' || {_TL} || ' chars — omitted from chat history]'
WHEN tool = 'document_outline' THEN '[Document index, ' || {_TL} || ' chars — omitted from chat history]' ELSE output END"""


@register("compact_tool_outputs", f"WITH {STEPS} SELECT path, seq, id, pos::INT AS pos, {_LINE} AS output FROM steps WHERE output IS NOT NULL")
def compact_tool_outputs(spark: SparkSession, d: str) -> DataFrame:
    return C.compact_outputs(C.tool_steps(messages(spark, d)))


@register("compact_run", f"""WITH {STEPS}, z AS (SELECT *, sum({_TL}) OVER w AS total, row_number() OVER w AS rn FROM steps WHERE output IS NOT NULL AND tool IN ('document_outline', 'search_in_document', 'read_pdf_page', 'read_pdf_range', 'read_section') WINDOW w AS (PARTITION BY path ORDER BY seq DESC, pos DESC))
SELECT path, seq, id, pos::INT AS pos, CASE WHEN total > 16000 AND rn > 1 THEN {_LINE} ELSE output END AS output FROM z UNION ALL
SELECT path, seq, id, pos::INT, output FROM steps WHERE output IS NOT NULL AND tool NOT IN ('document_outline', 'search_in_document', 'read_pdf_page', 'read_pdf_range', 'read_section')""")
def compact_run(spark: SparkSession, d: str) -> DataFrame:
    return C.compact_run(C.tool_steps(messages(spark, d)))


_SHOW = "array_to_string(list_transform(ps, lambda p: concat_ws('|', p.type, p.state, p.text, p.output)), '¶')"


@register("repair_dangling_tools", f"""WITH {MSG}, k AS (SELECT path, seq, id, list_filter(parts, lambda p: NOT (p.type LIKE 'tool-%' AND coalesce(p.state = 'input-streaming', false))) AS ps FROM msg)
SELECT path, seq, id, array_to_string(list_transform(ps, lambda p: CASE WHEN p.type LIKE 'tool-%' AND coalesce(p.state = 'input-available', false) THEN concat_ws('|', p.type, 'output-available', p.text, '[cancelled]') ELSE concat_ws('|', p.type, p.state, p.text, p.output) END), '¶') AS parts FROM k WHERE len(ps) > 0""")
def repair_dangling_tools(spark: SparkSession, d: str) -> DataFrame:
    return C.repair_dangling(messages(spark, d)).select("path", "seq", "id", C.shown_parts().alias("parts"))


@register("strip_reasoning", f"WITH {MSG}, k AS (SELECT path, seq, id, CASE WHEN role = 'assistant' THEN list_filter(parts, lambda p: p.type <> 'reasoning') ELSE parts END AS ps FROM msg) SELECT path, seq, id, {_SHOW} AS parts FROM k WHERE len(ps) > 0")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return C.strip_reasoning(messages(spark, d)).select("path", "seq", "id", C.shown_parts().alias("parts"))


@register("strip_files", f"""WITH {MSG}, l AS (SELECT path, max({{'s': seq, 'i': id}}) AS last FROM msg WHERE role = 'user' GROUP BY path),
k AS (SELECT msg.path, seq, id, CASE WHEN role <> 'user' OR {{'s': seq, 'i': id}} = last OR len(list_filter(parts, lambda p: p.type = 'file')) = 0 THEN parts ELSE list_filter(parts, lambda p: p.type <> 'file') END AS ps, parts FROM msg LEFT JOIN l USING (path))
SELECT path, seq, id, CASE WHEN len(ps) = 0 AND len(parts) > 0 THEN 'text| ' ELSE {_SHOW} END AS parts FROM k""")
def strip_files(spark: SparkSession, d: str) -> DataFrame:
    return M.strip_files(messages(spark, d), True).select("path", "seq", "id", C.shown_parts().alias("parts"))


_ITP = "json_extract_string(p.input, '$.{}')"
_OTP = "json_extract_string(p.output, '$.{}')"
_INT = lambda x: f"TRY_CAST({x} AS INT)"


@register("read_trail", f"""WITH {MSG}, q AS (SELECT path, seq, id, unnest(parts) AS p FROM msg WHERE role = 'assistant'),
r AS (SELECT path, seq, id, p.type AS type, {_INT(_ITP.format("page"))} AS pg, {_INT(_ITP.format("start"))} AS a, {_INT(_ITP.format("end"))} AS b, {_INT(_OTP.format("startPage"))} AS oa, {_INT(_OTP.format("endPage"))} AS ob FROM q
WHERE p.state IN ('input-available', 'output-available') AND p.type LIKE 'tool-%' AND NOT coalesce(p.output = '[cancelled]' OR ({_OTP.format("budgetExceeded")} = 'true' AND {_INT(_OTP.format("charCount"))} = 0), false)),
s AS (SELECT *, CASE WHEN coalesce(ob >= oa, false) THEN oa WHEN type = 'tool-read_pdf_range' THEN a END AS x, CASE WHEN coalesce(ob >= oa, false) THEN ob WHEN type = 'tool-read_pdf_range' THEN greatest(a, b) END AS y FROM r),
t AS (SELECT path, seq, id, unnest(CASE WHEN type = 'tool-read_pdf_page' THEN CASE WHEN pg >= 1 THEN [pg::BIGINT] END WHEN type IN ('tool-read_pdf_range', 'tool-read_section') AND x >= 1 THEN range(x, least(y, x + 300) + 1) END) AS page FROM s)
SELECT DISTINCT path, seq, id, page::INT AS page FROM t""")
def read_trail(spark: SparkSession, d: str) -> DataFrame:
    return C.read_trail(messages(spark, d))


@register("intent_flags", f"""WITH {MSG}, v AS (SELECT path, seq, id, {_VIS} AS t FROM msg WHERE role = 'user') SELECT path, seq, id, regexp_matches(t, '{C.CURRENT_PAGE.replace("'", "''")}') AS current_page, regexp_matches(t, '{C.WHOLE_DOCUMENT}') AS whole_document, NOT regexp_matches(t, '{C.WHOLE_DOCUMENT}') AND regexp_matches(t, '{C.FACTUAL}') AS factual FROM v""")
def intent_flags(spark: SparkSession, d: str) -> DataFrame:
    v = messages(spark, d).where("role = 'user'").select("path", "seq", "id", C.visible().alias("text"))
    return C.intents(v).drop("text")


_REF = C.PAGE_REF.replace("\\s", "[ \\t\\n\\f\\r]")


@register("page_refs_extracted", f"""WITH {MSG}, v AS (SELECT path, seq, id, {_VIS} AS t FROM msg), r AS (SELECT *, list_transform(list_zip(regexp_extract_all(t, '{_REF}', 1), regexp_extract_all(t, '{_REF}', 2)), lambda z: TRY_CAST(concat(z[1], z[2]) AS INT)) AS refs FROM v)
SELECT path, seq, id, array_to_string(list_filter(refs, lambda n: n >= 1), ',') AS refs FROM r WHERE len(list_filter(refs, lambda n: n >= 1)) > 0""")
def page_refs_extracted(spark: SparkSession, d: str) -> DataFrame:
    v = messages(spark, d).select("path", "seq", "id", C.visible().alias("text"))
    return C.page_refs(v).where(F.size("refs") > 0).select("path", "seq", "id", F.array_join("refs", ",").alias("refs"))


@register("claim_from_answer")
def claim_from_answer(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("role = 'assistant'").select("path", "seq", "id", C.claim(C.visible(), 300).alias("claim"))


@register("settle_events", """WITH e AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id FROM events), s AS (SELECT * FROM e WHERE n IS NULL OR n - ts >= INTERVAL 30 MINUTE),
p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM s) SELECT user_id, ts, event_type FROM p WHERE b IS NULL OR b <> event_type""")
def settle_events(spark: SparkSession, d: str) -> DataFrame:
    return E.settled(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id", 30 * 60)


@register("generation_guard", f"WITH {CP}, m AS (SELECT path, max(stamp) AS stamp FROM cp GROUP BY path) SELECT path, page FROM cp SEMI JOIN m USING (path, stamp)")
def generation_guard(spark: SparkSession, d: str) -> DataFrame:
    return E.current_generation(current(spark, d, ["stamp"]), "path", "stamp").select("path", "page")


@register("index_state_latest", "SELECT user_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'view'")
def index_state_latest(spark: SparkSession, d: str) -> DataFrame:
    return E.latest_state(table(spark, d, "events"), "user_id", "event_type", "event_id", "view")
