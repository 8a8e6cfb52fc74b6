"""Further core queries: messages, marks and findings, texts, geometry, each with the DuckDB statement that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.catalog import register
from leafmill.functions import text as T
from leafmill.operators import chat as C
from leafmill.operators import documents as D
from leafmill.operators import geometry as G
from leafmill.operators import messages as M
from leafmill.operators import pages as P
from leafmill.operators import stores as K
from leafmill.operators import structure as O
from leafmill.operators import usage as U
from leafmill.queries import _N, _TOT, _USE, _VIS, ACT, CP, FND, FP, MK, MSG, STEPS, _collapse, _trim, current, findings, first, marks_once, messages, sized, usable
from leafmill.sources import table
from leafmill.streaming import settle as E


def _cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN ({x})[1:{n}] || '…' ELSE {x} END"


def _texts(kinds: str, sep: str) -> str:
    return f"coalesce(array_to_string(list_filter(list_transform(list_filter(parts, lambda p: p.type IN ({kinds})), lambda p: {_trim('coalesce(p.text, chr(32))')}), lambda t: length(t) > 0), {sep}), '')"


@register("last_messages", f"WITH {MSG} SELECT path, seq, id, role FROM msg QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, id DESC) = 1")
def last_messages(spark: SparkSession, d: str) -> DataFrame:
    return M.last_messages(messages(spark, d).select("path", "seq", "id", "role"))


@register("awaiting_reply", f"WITH {MSG}, l AS (SELECT * FROM msg QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC, id DESC) = 1) SELECT path, role = 'user' AS awaits, CASE WHEN role = 'assistant' THEN id END AS in_flight FROM l")
def awaiting_reply(spark: SparkSession, d: str) -> DataFrame:
    return M.awaiting(messages(spark, d).select("path", "seq", "id", "role"))


@register("substantial_answers", f"""WITH {MSG} SELECT path, seq, id, coalesce(len(list_filter(parts, lambda p: p.type = 'text' AND length({_trim('coalesce(p.text, chr(32))')}) >= 8)) > 0, false) AS answers,
coalesce(len(list_filter(parts, lambda p: p.type IN ('text', 'reasoning') AND length({_trim('coalesce(p.text, chr(32))')}) >= 8)) > 0, false) AS says FROM msg WHERE role = 'assistant'""")
def substantial_answers(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("role = 'assistant'").select("path", "seq", "id", M.substantial().alias("answers"), M.substantial(reasoning=True).alias("says"))


@register("message_texts", f"""WITH {MSG} SELECT path, seq, id, {_texts("'text'", "chr(10)")} AS user_text, {_texts("'text', 'reasoning'", "chr(10) || chr(10)")} AS assistant_text,
coalesce(array_to_string(list_transform(list_filter(list_transform(list_filter(parts, lambda p: p.type LIKE 'tool-%' AND p.output IS NOT NULL), lambda p: {_trim("p.output")}), lambda o: length(o) > 0 AND o <> '[cancelled]' AND o NOT LIKE '% — omitted from chat history]'), lambda o: o[1:1200]), chr(10) || '---' || chr(10))[1:6000], '') AS excerpts FROM msg""")
def message_texts(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("path", "seq", "id", M.user_text().alias("user_text"), M.assistant_text().alias("assistant_text"), M.tool_excerpts().alias("excerpts"))


@register("messages_for_send", f"""WITH {MSG}, k AS (SELECT path, seq, id, role, list_filter(parts, lambda p: NOT (p.type LIKE 'tool-%' AND coalesce(p.state = 'input-streaming', false))) AS ps FROM msg WHERE len(parts) > 0),
u AS (SELECT *, CASE WHEN role = 'user' THEN list_filter(ps, lambda p: p.type <> 'file') ELSE ps END AS q FROM k WHERE len(ps) > 0)
SELECT path, seq, id, greatest(len(q), 1)::INT AS n_parts, len(list_filter(q, lambda p: p.type LIKE 'tool-%' AND coalesce(p.state = 'input-available', false)))::INT AS cancelled FROM u""")
def messages_for_send(spark: SparkSession, d: str) -> DataFrame:
    ready = M.for_send(messages(spark, d))
    return ready.select("path", "seq", "id", F.size("parts").alias("n_parts"), F.size(F.filter("parts", lambda p: p.output == C.CANCELLED)).alias("cancelled"))


@register("message_neighbours", f"WITH {MSG} SELECT path, seq, id, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM msg WINDOW w AS (PARTITION BY path ORDER BY seq, id)")
def message_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return M.neighbours(messages(spark, d))


@register("message_segments")
def message_segments(spark: SparkSession, d: str) -> DataFrame:
    return C.segments(messages(spark, d))


@register("thread_signatures")
def thread_signatures(spark: SparkSession, d: str) -> DataFrame:
    return M.signature(messages(spark, d))


@register("newest_messages", f"WITH {MSG} SELECT path, seq, id FROM msg QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 16")
def newest_messages(spark: SparkSession, d: str) -> DataFrame:
    return E.newest_rows(messages(spark, d).select("path", "seq", "id"), "path", "seq")


@register("stamp_finished", f"WITH {MSG} SELECT path, seq, id, CASE WHEN role = 'assistant' AND metadata.started_at IS NOT NULL AND metadata.finished_at IS NULL THEN 1800000000000 ELSE metadata.finished_at END AS finished_at FROM msg")
def stamp_finished(spark: SparkSession, d: str) -> DataFrame:
    return U.stamp_finished(messages(spark, d), 1_800_000_000_000).select("path", "seq", "id", F.col("metadata.finished_at").alias("finished_at"))


@register("usage_labels", f"""WITH {MSG}, u AS (SELECT path, sum(coalesce(metadata.input_tokens, 0))::BIGINT AS i, sum(coalesce(metadata.output_tokens, 0))::BIGINT AS o, sum(CASE WHEN metadata.finished_at IS NOT NULL AND metadata.started_at IS NOT NULL THEN greatest(0, metadata.finished_at - metadata.started_at) ELSE 0 END)::BIGINT AS ms,
sum(CASE WHEN metadata.finished_at > metadata.started_at THEN metadata.output_tokens END) AS tt FROM msg GROUP BY path), f AS (SELECT *, CASE WHEN tt > 0 AND ms > 0 THEN round(tt::DOUBLE * 1000.0 / ms::DOUBLE, 1) END AS s FROM u)
SELECT path, CASE WHEN i < 1000 THEN i::VARCHAR WHEN i < 10000 THEN printf('%.1fk', floor(i / 100.0 + 0.5) / 10) ELSE floor(i::DOUBLE / 1000 + 0.5)::BIGINT || 'k' END AS input, CASE WHEN o < 1000 THEN o::VARCHAR WHEN o < 10000 THEN printf('%.1fk', floor(o / 100.0 + 0.5) / 10) ELSE floor(o::DOUBLE / 1000 + 0.5)::BIGINT || 'k' END AS output,
CASE WHEN ms < 1000 THEN ms || 'ms' ELSE printf('%.1fs', floor(ms / 100.0 + 0.5) / 10) END AS time, CASE WHEN s > 0 THEN printf('%.1f T/s', s) ELSE '—' END AS speed FROM f""")
def usage_labels(spark: SparkSession, d: str) -> DataFrame:
    return U.labels(C.usage_totals(messages(spark, d)))


@register("step_usage", """WITH e AS (SELECT user_id::VARCHAR AS msg, hour(ts)::INT AS step, ts, event_id, CASE WHEN event_type <> 'view' THEN value END AS input_tokens, CASE WHEN event_type = 'view' THEN value END AS output_tokens FROM events),
s AS (SELECT msg, step, arg_max(input_tokens, event_id) FILTER (input_tokens IS NOT NULL) AS i, arg_max(output_tokens, event_id) FILTER (output_tokens IS NOT NULL) AS o FROM e GROUP BY msg, step)
SELECT msg, count(*) AS steps, round(sum(coalesce(i, 0)), 4) AS input_tokens, round(sum(coalesce(o, 0)), 4) AS output_tokens FROM s GROUP BY msg""")
def step_usage(spark: SparkSession, d: str) -> DataFrame:
    """The events of a user as a run, those of an hour as a step, told in pieces."""
    view = F.col("event_type") == "view"
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("msg"), F.hour("ts").alias("step"), F.col("event_id").alias("ts"), F.when(~view, F.col("value")).alias("input_tokens"), F.when(view, F.col("value")).alias("output_tokens"), F.lit(None).cast("int").alias("cached_tokens"), F.lit(None).cast("array<string>").alias("tool_names"))
    return U.message_usage(U.step_usage(e)).select("msg", "steps", F.round("input_tokens", 4).alias("input_tokens"), F.round("output_tokens", 4).alias("output_tokens"))


@register("tool_inputs", f"""WITH {STEPS}, n AS (SELECT path, seq, pos, TRY_CAST(TRY_CAST(json_extract_string(input, '$.page') AS DOUBLE) AS INT) AS page, TRY_CAST(TRY_CAST(json_extract_string(input, '$.start') AS DOUBLE) AS INT) AS a, TRY_CAST(TRY_CAST(json_extract_string(input, '$.end') AS DOUBLE) AS INT) AS b FROM steps)
SELECT path, seq, pos::INT AS pos, page, CASE WHEN coalesce(a > b, false) THEN b ELSE a END AS "start", CASE WHEN coalesce(a > b, false) THEN a ELSE b END AS "end" FROM n""")
def tool_inputs(spark: SparkSession, d: str) -> DataFrame:
    return C.tool_steps(messages(spark, d)).select("path", "seq", "pos", D.tool_input(F.col("input")).alias("i")).select("path", "seq", "pos", "i.page", "i.start", "i.end")


@register("meta_loops", f"""WITH {STEPS}, st AS (SELECT path, seq, bool_and(tool IN ('document_outline', 'search_in_document')) AS meta FROM steps GROUP BY path, seq),
rk AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) <= 3), nr AS (SELECT path, bool_and(meta) AND count(*) = 3 AS meta, min(seq) AS since FROM rk GROUP BY path),
ag AS (SELECT path, max(c) > 1 AS again FROM (SELECT s.path, tool, coalesce(input, '') AS i, count(*) AS c FROM steps s JOIN nr USING (path) WHERE s.seq >= since AND tool IN ('document_outline', 'search_in_document') GROUP BY ALL) GROUP BY path)
SELECT path AS run, meta AND coalesce(again, false) AS loop FROM nr LEFT JOIN ag USING (path)""")
def meta_loops(spark: SparkSession, d: str) -> DataFrame:
    return C.meta_loops(C.tool_steps(messages(spark, d)).select(F.col("path").alias("run"), F.col("seq").alias("step"), "tool", "input"))


@register("explicit_pages")
def explicit_pages(spark: SparkSession, d: str) -> DataFrame:
    v = messages(spark, d).where("role = 'user'").select("path", "seq", "id", C.visible().alias("t"))
    return v.select("path", "seq", "id", T.page_numbers(F.col("t")).alias("n")).where(F.size("n") > 0).select("path", "seq", "id", F.array_join("n", ",").alias("pages"))


@register("follow_agent")
def follow_agent(spark: SparkSession, d: str) -> DataFrame:
    """Each page read in an answer, whether a preview that shows page 1 goes there for the question before it."""
    m = messages(spark, d)
    ask = m.where("role = 'user'").select("path", F.col("seq").alias("asked"), C.visible().alias("t"))
    last = m.where("role = 'assistant'").select("path", "seq", F.explode(C.read_pages()).alias("page"))
    near = last.join(ask.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("asked") == F.col("seq") - 1), "left")
    return near.select("path", "seq", "page", C.follows(F.col("page"), F.col("t"), F.lit(1)).alias("follows"))


@register("findings_sanitized", f"""WITH {FND}, v AS (SELECT *, list_sort(list_distinct(list_filter(coalesce(pages, []), lambda p: p >= 1)))[1:20] AS ps FROM fnd WHERE path IS NOT NULL AND id <> '')
SELECT path, row_number() OVER (PARTITION BY path ORDER BY created_at, id)::INT AS pos, id, claim[1:500] AS claim, evidence[1:1000] AS evidence, coalesce(author, 'assistant') AS author FROM v WHERE len(ps) > 0 AND length({_trim("claim")}) > 0 QUALIFY pos <= 500""")
def findings_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return K.sanitize_findings(table(spark, d, "findings")).select("path", "pos", "id", "claim", "evidence", "author")


@register("findings_on_page", f"WITH {FND} SELECT path, id FROM fnd WHERE list_contains(pages, 3)")
def findings_on_page(spark: SparkSession, d: str) -> DataFrame:
    return K.on_page(findings(spark, d), 3).select("path", "id")


@register("findings_ordered", f"WITH {FND} SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY created_at, id)::INT AS pos FROM fnd")
def findings_ordered(spark: SparkSession, d: str) -> DataFrame:
    return K.ordered(findings(spark, d)).select("path", "id", "pos")


_REC = f"'- ' || {_cut(_collapse('claim'), 300)} || ' (p. ' || array_to_string(pages, ', ') || ')'"


@register("record_lines", f"""WITH {FND}, {ACT}, l AS (SELECT path, id, created_at, {_REC} AS line FROM act), u AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY path ORDER BY created_at DESC, id DESC ROWS UNBOUNDED PRECEDING) <= 300 AS fits FROM l)
SELECT path, coalesce(string_agg(CASE WHEN fits THEN line END, chr(10) ORDER BY created_at, id), '') AS lines, count(*) FILTER (NOT fits) AS omitted FROM u GROUP BY path""")
def record_lines(spark: SparkSession, d: str) -> DataFrame:
    return K.record_lines(findings(spark, d), 300)


@register("marks_stale", f"WITH {MK}, cur AS (SELECT path, max(stamp) AS now FROM docmodels GROUP BY path) SELECT path, bool_or(now <> '' AND stamp <> now) AS stale FROM mk1 JOIN cur USING (path) GROUP BY path")
def marks_stale(spark: SparkSession, d: str) -> DataFrame:
    return K.marks_stale(marks_once(spark, d), table(spark, d, "docmodels").groupBy("path").agg(F.max("stamp").alias("now")))


@register("marks_filter", f"WITH {MK} SELECT path, id FROM mk1 WHERE contains(lower(nfc_normalize(concat_ws(chr(10), text, note))), 'contract')")
def marks_filter(spark: SparkSession, d: str) -> DataFrame:
    return K.filter_rows(marks_once(spark, d), ["text", "note"], " Contract ").select("path", "id")


@register("outline_marks", f"""WITH {MK}, few AS (SELECT path FROM mk1 GROUP BY path HAVING count(*) <= 100)
SELECT path, row_number() OVER (PARTITION BY path ORDER BY page, created_at, id)::INT AS pos, page, {_cut("text", 120)} AS text, note FROM mk1 SEMI JOIN few USING (path)""")
def outline_marks(spark: SparkSession, d: str) -> DataFrame:
    return K.outline_marks(marks_once(spark, d))


@register("marks_on_delivered", f"""WITH {MK}, {CP} SELECT path, page, row_number() OVER (PARTITION BY path, page ORDER BY created_at, id)::INT AS ord, {_cut("coalesce(text, '')", 120)} AS text, nullif(note, '') AS note FROM mk1 WHERE (path, page) IN (SELECT (path, page) FROM cp WHERE page % 2 = 1)""")
def marks_on_delivered(spark: SparkSession, d: str) -> DataFrame:
    return D.marks_on(marks_once(spark, d), sized(spark, d).where("page % 2 = 1"))


@register("empty_export_pages", f"WITH {CP} SELECT path, page FROM cp WHERE length({_trim("coalesce(text, '')")}) = 0")
def empty_export_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.empty_pages(current(spark, d, ["text"]))


@register("blank_recovery", f"""WITH {FP}, {CP} SELECT a.path, a.page, CASE WHEN length({_trim("coalesce(a.text, '')")}) = 0 THEN coalesce(nullif({_trim("b.text")}, ''), a.text) ELSE a.text END AS text FROM fp a JOIN cp b ON a.path = b.path AND a.page = b.page""")
def blank_recovery(spark: SparkSession, d: str) -> DataFrame:
    """First extractions, blank ones mended by the latest."""
    return P.recovered(first(spark, d), current(spark, d, ["text"])).select("path", "page", "text")


@register("page_previews", f"""WITH {CP} SELECT path, page, coalesce(length(text), 0)::INT AS chars, {_collapse("coalesce(text, '')[1:1200]")}[1:60] AS preview FROM cp QUALIFY row_number() OVER (PARTITION BY path ORDER BY page) <= 200""")
def page_previews(spark: SparkSession, d: str) -> DataFrame:
    return P.previews(current(spark, d, ["text"]))


@register("pending_pages", f"WITH {CP} SELECT path, page FROM cp WHERE {_N} < 20")
def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    return P.sparse(current(spark, d, ["text"]), None)


@register("reindexed_pages", f"WITH {CP}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page) AS n FROM cp) SELECT path, page, CASE WHEN n <= 50 AND source = 'vision' THEN '' ELSE text END AS text FROM r")
def reindexed_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = current(spark, d)
    return K.reindexed(pages, pages.select("path", "page"))[0].select("path", "page", "text")


@register("reindexed_cache", f"WITH {CP}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY page) AS n FROM cp) SELECT path, page FROM r WHERE n > 50")
def reindexed_cache(spark: SparkSession, d: str) -> DataFrame:
    pages = current(spark, d, ["source", "text"])
    return K.reindexed(pages, pages.select("path", "page"))[1]


@register("next_sections", f"""WITH {_TOT}, {_USE}, l AS (SELECT path, max(page) AS last FROM marks GROUP BY path) SELECT path, {_trim("arg_min(title, ord)")}[1:60] AS section FROM us JOIN l USING (path) WHERE page > last GROUP BY path""")
def next_sections(spark: SparkSession, d: str) -> DataFrame:
    """The section after the last marked page."""
    return O.next_section(usable(spark, d), table(spark, d, "marks").select("path", "page"))


@register("outline_flattened", f"SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord) - 1)::INT AS ord, {_collapse('title')}[1:200] AS title, page, level FROM outline QUALIFY row_number() OVER (PARTITION BY path ORDER BY ord) <= 100")
def outline_flattened(spark: SparkSession, d: str) -> DataFrame:
    return O.flattened(table(spark, d, "outline"))


@register("follow_ups", f"""WITH {CP}, b AS (SELECT path, count(*) AS total, count(*) FILTER ({_N} < 20) AS un FROM cp GROUP BY path), m AS (SELECT path, count(*) AS marks, count(DISTINCT page) AS seen FROM marks GROUP BY path),
k AS (SELECT path, list_filter([CASE WHEN un > 0 THEN 'scanUnindexed' END, CASE WHEN coalesce(marks, 0) > 0 THEN 'compareMarks' END, CASE WHEN total > 1 AND coalesce(seen, 0) / total < 0.25 THEN 'wholeDocument' END], lambda x: x IS NOT NULL)[1:3] AS ks FROM b LEFT JOIN m USING (path))
SELECT path, (i - 1)::INT AS ord, ks[i] AS kind FROM (SELECT path, ks, unnest(range(1, len(ks) + 1)) AS i FROM k)""")
def follow_ups(spark: SparkSession, d: str) -> DataFrame:
    base = sized(spark, d).groupBy("path").agg(F.count("*").alias("total_pages"), F.count_if("sparse").alias("unindexed_count"))
    marked = table(spark, d, "marks").groupBy("path").agg(F.count("*").alias("mark_count"), F.count_distinct("page").alias("read_count"))
    return D.follow_ups(base.join(marked, "path", "left").withColumn("section", F.lit(None).cast("string")))


@register("prompt_names", f"""SELECT DISTINCT path, name, {_cut(_collapse("translate(regexp_replace(coalesce(title, name), '[\\x00-\\x1f\\x7f-\\x9f]', ' ', 'g'), chr(34) || '“”„‟`', chr(39) || chr(39) || chr(39) || chr(39) || chr(39) || chr(39))"), 24)} AS shown FROM docmodels""")
def prompt_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docmodels").select("path", "name", T.for_prompt(F.coalesce("title", "name"), 24).alias("shown")).distinct()


@register("document_kinds", """SELECT DISTINCT path, CASE WHEN lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) = 'pdf' THEN 'pdf' WHEN lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) IN ('png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff', 'bmp', 'gif') THEN 'image' END AS kind, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM docmodels""")
def document_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "docmodels").select("path", T.document_kind(F.col("path")).alias("kind"), T.base_name(F.col("path")).alias("name")).distinct()


@register("cache_keys", "SELECT DISTINCT path || '|odd' AS path, page::VARCHAR AS page, 'w640' AS scale, '2' AS dpr FROM marks")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat("path", F.lit("|odd|"), F.col("page").cast("string"), F.lit("|w640|high|2"))
    return table(spark, d, "marks").select(T.page_cache_key(key).alias("k")).select("k.path", "k.page", "k.scale", "k.dpr").distinct()


_SIZES = "sz AS (SELECT path, page, CASE WHEN page % 5 <> 4 THEN 500.0 + page % 3 * 61 END AS width, CASE WHEN page % 5 <> 4 THEN 700.0 + page % 7 * 33 END AS height FROM cp WHERE path IS NOT NULL)"
_LAID = f"""{CP}, {_SIZES}, fs AS (SELECT path, arg_min({{'w': width, 'h': height}}, page) AS f FROM sz WHERE width IS NOT NULL GROUP BY path),
px AS (SELECT path, page, greatest(1, floor(coalesce(height, f.h, 792) * 0.75 + 0.5))::INT AS height, greatest(1, floor(coalesce(width, f.w, 612) * 0.75 + 0.5))::INT AS width FROM sz LEFT JOIN fs USING (path)),
laid AS (SELECT path, page, (16 + coalesce(sum(height + 16) OVER (PARTITION BY path ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS top, height, width FROM px)"""
_VIEWS = f"""{_LAID}, vw AS (SELECT path, v, v * 433 AS scroll, 800 AS vh FROM (SELECT DISTINCT path FROM laid) CROSS JOIN range(0, 8) t(v)), tt AS (SELECT path, max(top + height + 16) AS total, max(page) AS n FROM laid GROUP BY path),
se AS (SELECT vw.*, total, n, page, top, height, least(top + height, scroll + vh) - greatest(top, scroll) AS seen, top >= scroll AND top + height <= scroll + vh AS whole FROM vw JOIN tt USING (path) JOIN laid USING (path)),
pa AS (SELECT path, v, coalesce(max(CASE WHEN total > vh AND scroll >= total - vh - 1 THEN n END), min(page) FILTER (whole AND seen > 0), arg_max(page, seen * 100000 - page) FILTER (seen > 0), max(CASE WHEN page = n AND scroll >= top THEN n END), 1) AS page FROM se GROUP BY path, v)"""


def _laid(spark: SparkSession, d: str) -> DataFrame:
    measured = F.col("page") % 5 != 4
    sizes = sized(spark, d).where("path is not null").select("path", "page", F.when(measured, 500.0 + F.col("page") % 3 * 61).alias("width"), F.when(measured, 700.0 + F.col("page") % 7 * 33).alias("height"))
    return G.layout(sizes, 0.75)


def _views(laid: DataFrame) -> DataFrame:
    return laid.select("path").distinct().select("path", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("view")).withColumns({"scroll": F.col("view") * 433, "height": F.lit(800)})


@register("page_layout", f"WITH {_LAID} SELECT * FROM laid")
def page_layout(spark: SparkSession, d: str) -> DataFrame:
    """Pages of made sizes, every fifth unmeasured."""
    return _laid(spark, d)


@register("page_at_scroll", f"WITH {_VIEWS} SELECT path, v::INT AS view, page FROM pa")
def page_at_scroll(spark: SparkSession, d: str) -> DataFrame:
    laid = _laid(spark, d)
    return G.page_at(laid, _views(laid))


@register("visible_pages", f"WITH {_VIEWS}, x AS (SELECT path, v, min(page) FILTER (seen > 0) AS a, max(page) FILTER (seen > 0) AS b, max(n) AS n FROM se GROUP BY path, v) SELECT path, v::INT AS view, greatest(1, coalesce(a, page) - 1) AS first, least(n, coalesce(b, page) + 1) AS last FROM x JOIN pa USING (path, v)")
def visible_pages(spark: SparkSession, d: str) -> DataFrame:
    laid = _laid(spark, d)
    return G.visible_pages(laid, _views(laid))


@register("page_offsets", f"WITH {_LAID}, e AS (SELECT path, max(page) AS n FROM laid GROUP BY path) SELECT path, 3 AS page, greatest(0, top - 16) AS scroll FROM e JOIN laid USING (path) WHERE laid.page = least(n, 3)")
def page_offsets(spark: SparkSession, d: str) -> DataFrame:
    laid = _laid(spark, d)
    return G.page_offset(laid, laid.select("path").distinct().withColumn("page", F.lit(3)))


_FIG = f"{MK}, fg AS (SELECT path, page, id, (unnest(list_zip(rects, range(len(rects))))) AS z FROM mk1), fr AS (SELECT path, page, id || '/' || z[2] AS ord, z[1] AS r FROM fg)"


@register("figures_by_area", f"WITH {_FIG} SELECT path, page, ord, row_number() OVER (PARTITION BY path, page ORDER BY r.width * r.height DESC, ord)::INT AS index FROM fr WHERE r.width >= 24 AND r.height >= 24")
def figures_by_area(spark: SparkSession, d: str) -> DataFrame:
    """The rectangles of marks taken as figures."""
    rects = marks_once(spark, d).select("path", "page", "id", F.posexplode("rects").alias("i", "rect_bl")).withColumn("ord", F.concat("id", F.lit("/"), F.col("i").cast("string")))
    return G.figures_on(rects).select("path", "page", "ord", "index")


@register("chat_export", f"""WITH {MSG}, t AS (SELECT path, seq, id, role, {_texts("'text'", "chr(10)")} AS t, len(list_filter(parts, lambda p: p.type LIKE 'tool-%')) AS tools, len(list_filter(parts, lambda p: p.type = 'file')) AS files FROM msg),
b AS (SELECT *, CASE WHEN length(t) > 0 THEN t WHEN role = 'assistant' AND tools > 0 THEN '_' || tools || ' tool step(s)_' WHEN role = 'user' AND files > 0 THEN '_(image attachment)_' END AS body FROM t)
SELECT path, seq, id, '## ' || CASE WHEN role = 'user' THEN 'You' ELSE 'Assistant' END || chr(10) || chr(10) || body AS block FROM b WHERE body IS NOT NULL""")
def chat_export(spark: SparkSession, d: str) -> DataFrame:
    return K.chat_blocks(messages(spark, d))


@register("openable_documents", """SELECT DISTINCT path FROM docmodels WHERE lower(regexp_extract(path, '\\.([^./\\\\]*)$', 1)) IN ('pdf', 'png', 'jpg', 'jpeg', 'webp', 'tif', 'tiff', 'bmp', 'gif')""")
def openable_documents(spark: SparkSession, d: str) -> DataFrame:
    return K.openable(table(spark, d, "docmodels")).select("path").distinct()


@register("run_limits", f"WITH {CP} SELECT path, least(30, greatest(20, count(*)))::BIGINT AS steps FROM cp GROUP BY path")
def run_limits(spark: SparkSession, d: str) -> DataFrame:
    return sized(spark, d).groupBy("path").agg(F.count("*").alias("n")).select("path", U.most_steps(F.col("n")).alias("steps"))


@register("answer_texts_clean", f"WITH {MSG} SELECT path, seq, id, {_trim(_VIS)} AS text FROM msg WHERE role = 'assistant'")
def answer_texts_clean(spark: SparkSession, d: str) -> DataFrame:
    """Answers without leaked tool markup; the data have none, so they come out trimmed alone."""
    return messages(spark, d).where("role = 'assistant'").select("path", "seq", "id", T.without_leaked_markup(C.visible()).alias("text"))
