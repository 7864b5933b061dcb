"""Registered queries over the tables, with SQL for comparison where SQL can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrublake import fixtures as X
from scrublake import oracle as O
from scrublake.functions import boxes as G
from scrublake.functions.text import around, fingerprint, matches
from scrublake.operators import fields, lines, merge, sanitize, scan, vision
from scrublake.operators import rules as R
from scrublake.plans import detect
from scrublake.sources import inventory, pages
from scrublake.streaming import detect as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- detection

_DOCS = f"SELECT doc_id, text FROM documents UNION ALL {X.texts_sql(X.TEXTS)}"
_SRC = f"SELECT doc_id k, text FROM ({_DOCS}) WHERE text IS NOT NULL"


def _scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(X.texts_sql(X.TEXTS)).select(F.col("doc_id").cast("long"), "text"))
    return scan.scan_text(docs).drop("id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in documents, counted by type and confidence."""
    found = scan.scan_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("type", "confidence").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(O.scan(_SRC))
def pii_scan(spark, sf_dir):
    return _scanned(spark, sf_dir)


for _name, _types in {"pii_email": ("EMAIL",), "pii_cards": ("CREDIT_CARD",), "pii_phone": ("PHONE",), "pii_ids_accounts": ("NATIONAL_ID", "ACCOUNT_NUM")}.items():
    QUERIES[_name] = lambda spark, sf_dir, t=_types: _scanned(spark, sf_dir).where(F.col("type").isin(*t))
    ORACLE_SQL[_name] = O.scan(_SRC, "\"type\" IN (" + ", ".join(f"'{t}'" for t in _types) + ")")


@query(f"SELECT \"type\", confidence, count(*)::BIGINT n, count(DISTINCT doc_id)::BIGINT n_docs FROM ({O.scan('SELECT doc_id k, text FROM documents WHERE text IS NOT NULL')}) GROUP BY ALL")
def pii_counts(spark, sf_dir):
    return flagship(spark, sf_dir)


#: What makes a static text worth a scan.
PREFILTER = {
    "EMAIL": R.EMAIL, "PHONE": rf"{R.B}(?:\+?[1-9][0-9]{{0,2}}{R.SEP}?)?\(?[0-9]{{3}}\)?{R.SEP}?[0-9]{{3}}{R.SEP}?[0-9]{{4}}{R.B}", "CREDIT_CARD": R.CARD, "NATIONAL_ID": R.ID12, "ACCOUNT_NUM": R.ACCOUNT,
}


def prefilter(text: Column) -> Column:
    """Names of the patterns that the text holds; all of these hold an at sign or three digits together."""
    return F.when(~F.contains(text, F.lit("@")) & ~text.rlike("[0-9]{3}"), F.array().cast("array<string>")).otherwise(_named(text))


def _named(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in PREFILTER.items())))


_PRE = ", ".join(f"CASE WHEN regexp_matches(text, {O.pattern(p)}) THEN '{n}' END" for n, p in PREFILTER.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_PRE}], lambda x: x IS NOT NULL), ',') patterns FROM ({_DOCS}) WHERE len(list_filter([{_PRE}], lambda x: x IS NOT NULL)) > 0")
def static_prefilter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(X.texts_sql(X.TEXTS)).select(F.col("doc_id").cast("long"), "text"))
    may = F.contains("text", F.lit("@")) | F.col("text").rlike("[0-9]{3}")
    return docs.where(may).select("doc_id", F.array_join(_named(F.col("text")), ",").alias("patterns")).where("patterns <> ''")


@query("SELECT doc_id, md5(translate(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), 'oilzsbgau', '111258940')) fingerprint FROM documents WHERE text IS NOT NULL")
def value_fingerprint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.md5(fingerprint(F.col("text"))).alias("fingerprint"))


@query(
    f"WITH p AS (SELECT doc_id, text, string_split_regex(text, {O.pattern(R.EMAIL)}) g, regexp_extract_all(text, {O.pattern(R.EMAIL)}) m FROM documents WHERE contains(text, '@')),"
    "q AS (SELECT doc_id, text, unnest(range(1, len(m) + 1)) i, m, g FROM p), r AS (SELECT doc_id, text, m[i] \"value\", (list_sum(list_transform(g[1:i], lambda x: length(x))) "
    "+ coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::INTEGER \"start\" FROM q)"
    f"SELECT doc_id, \"value\", \"start\", {O.around('text', '\"start\"', '\"start\" + length(\"value\")')} context FROM r"
)
def context_window(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    rows = docs.select("doc_id", "text", F.inline(matches(F.col("text"), R.EMAIL)))
    return rows.select("doc_id", "value", "start", around(F.col("text"), F.col("start"), F.col("end")).alias("context"))


def _fixture_detections(spark: SparkSession) -> DataFrame:
    d = spark.sql(X.DETECTIONS_SQL)
    box = F.struct(*(F.col(a).cast("double").alias(b) for a, b in (("l", "left"), ("t", "top"), ("w", "width"), ("h", "height"))))
    return d.select(
        F.col("page_id").cast("long"), F.col("det_no").cast("int"), "id", "type", "text", box.alias("bbox"), "source", F.array("source").alias("sources"),
        F.lit(None).cast("string").alias("selector"), F.col("confidence").cast("double"), F.lit(None).cast("string").alias("context"),
    )


#: Detections by arithmetic on order lines, in SQL that both engines read: look-alike values, boxes that overlap more or less, some without area.
_MADE = {
    "page_id": "l_orderkey", "det_no": "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey % 10000", "id": "concat(CASE WHEN l_linestatus = 'F' THEN 'dom-' ELSE 'ocr-' END, l_partkey)",
    "type": "CASE l_returnflag WHEN 'R' THEN 'PHONE' WHEN 'A' THEN 'EMAIL' ELSE 'NAME' END", "text": "CASE l_partkey % 4 WHEN 0 THEN 'Oil-ZS' WHEN 1 THEN '111 25 ' WHEN 2 THEN 'someone else' ELSE '••••••••' END",
    "l": "CAST((l_suppkey % 3) * 15 AS DOUBLE)", "t": "CAST((l_partkey % 2) * 12 AS DOUBLE)", "w": "CASE WHEN l_quantity < 5 THEN CAST(0 AS DOUBLE) ELSE CAST(40 AS DOUBLE) END", "h": "CAST(20 AS DOUBLE)",
    "source": "CASE WHEN l_linestatus = 'F' THEN 'DOM' ELSE 'OCR' END", "selector": "CASE WHEN l_linestatus = 'F' THEN concat('#s', l_suppkey) END", "confidence": "CAST(0.5 AS DOUBLE) + l_discount",
    "context": "CASE WHEN l_linenumber % 2 = 0 THEN concat('c', l_linenumber) END",
}


def _made_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(*(F.expr(x).alias(c) for c, x in _MADE.items()))
    box = F.struct(*(F.col(a).alias(b) for a, b in (("l", "left"), ("t", "top"), ("w", "width"), ("h", "height"))))
    return d.select("page_id", "det_no", "id", "type", "text", box.alias("bbox"), "source", F.array("source").alias("sources"), "selector", "confidence", "context")


_FP = "translate(regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g'), 'oilzsbgau', '111258940')"
_ITEM = "STRUCT(id VARCHAR, type VARCHAR, text VARCHAR, fp VARCHAR, l DOUBLE, t DOUBLE, w DOUBLE, h DOUBLE, source VARCHAR, dom BOOLEAN, ocr BOOLEAN, selector VARCHAR, confidence DOUBLE, context VARCHAR)"


def _merge_sql() -> str:
    """Common tables up to m: page_id, det_no and r, the merged detections, by the same fold as a reduction of lists."""
    w, h = "(least(a.l + a.w, x[1].l + x[1].w) - greatest(a.l, x[1].l))", "(least(a.t + a.h, x[1].t + x[1].h) - greatest(a.t, x[1].t))"
    least = "least(a.w * a.h, x[1].w * x[1].h)"
    same = f"(a.type = x[1].type AND CASE WHEN {w} <= 0 OR {h} <= 0 OR {least} <= 0 THEN false ELSE {w} * {h} / {least} > 0.3::DOUBLE END AND (a.fp = x[1].fp OR a.text = x[1].text))"
    pick = lambda c: f"CASE WHEN x[1].source = 'DOM' THEN x[1].{c} ELSE b.{c} END"
    other = lambda c: f"CASE WHEN x[1].source = 'DOM' THEN b.{c} ELSE x[1].{c} END"
    merged = ", ".join(
        [f"'{c}': {pick(c)}" for c in ("id", "type", "text", "fp", "l", "t", "w", "h", "source")]
        + ["'dom': b.dom OR x[1].dom", "'ocr': b.ocr OR x[1].ocr", f"'selector': coalesce({pick('selector')}, {other('selector')})", "'confidence': greatest(b.confidence, x[1].confidence)", f"'context': coalesce({pick('context')}, {other('context')})"]
    )
    made = ", ".join(f"{x} \"{c}\"" for c, x in _MADE.items())
    item = ", ".join(f"'{c}': \"{c}\"" for c in ("id", "type", "text")) + f", 'fp': {_FP}, " + ", ".join(f"'{c}': \"{c}\"" for c in ("l", "t", "w", "h", "source")) + ", 'dom': source = 'DOM', 'ocr': source = 'OCR', 'selector': selector, 'confidence': confidence, 'context': context"
    place = f"list_position(list_transform(acc, lambda a: {same}), true)"
    return (
        f"WITH d AS (SELECT {made} FROM lineitem), g AS (SELECT page_id, list([{{{item}}}::{_ITEM}] ORDER BY det_no) d FROM d GROUP BY page_id),"
        f"f AS (SELECT page_id, list_reduce(list_prepend([]::{_ITEM}[], d), lambda acc, x: CASE WHEN {place} IS NULL THEN list_concat(acc, x)"
        f" ELSE list_transform(acc, lambda b, i: CASE WHEN i = {place} THEN {{{merged}}}::{_ITEM} ELSE b END) END) k FROM g),"
        "m AS (SELECT page_id, unnest(range(0, len(k)))::INTEGER det_no, unnest(k) r FROM f)"
    )


_MASKED = "CASE WHEN length(r.text) > 6 THEN substr(r.text, 1, 6) || '…' ELSE r.text END"
_SOURCES = "CASE WHEN r.dom AND r.ocr THEN 'DOM{0}OCR' WHEN r.dom THEN 'DOM' ELSE 'OCR' END"


@query(
    f"{_merge_sql()} SELECT page_id, count(*)::BIGINT total, count(*) FILTER (r.source = 'DOM')::BIGINT dom_flagged, count(*) FILTER (r.source <> 'DOM')::BIGINT ocr_flagged, count(*) FILTER (r.ocr)::BIGINT ocr_matched,"
    "count(*) FILTER (r.dom AND r.ocr)::BIGINT corroborated FROM m GROUP BY page_id"
)
def pii_summary(spark, sf_dir):
    return merge.summarize(merge.merge_sources(_made_detections(spark, sf_dir)), "page_id")


@query(
    f"{_merge_sql()} SELECT page_id, det_no, r.id id, r.\"type\" \"type\", {_MASKED} \"text\", r.source source, {_SOURCES.format(',')} sources, r.selector selector, r.confidence confidence, r.context context, r.l \"left\", r.t top FROM m"
)
def merged_sources(spark, sf_dir):
    m = merge.merge_sources(_made_detections(spark, sf_dir))
    return m.select("page_id", "det_no", "id", "type", merge.masked(F.col("text")).alias("text"), "source", F.array_join("sources", ",").alias("sources"), "selector", "confidence", "context", "bbox.left", "bbox.top")


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scanned as static text and as recognised words of the same page, a node filling it, and merged."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    whole = F.struct(*(F.lit(v).alias(k) for k, v in (("left", 0.0), ("top", 0.0), ("width", 1e9), ("height", 1e9))))
    nodes = d.select(F.col("doc_id").alias("page_id"), F.lit(0).alias("node_idx"), whole.alias("bbox"), F.lit("body").alias("selector"), "text")
    return detect.scan(static_nodes=nodes, lines=_lines_on_grid(d.select(F.col("doc_id").alias("frame_id"), "text")))


@query()
def corroborated_scan(spark, sf_dir):
    return _both(spark, sf_dir).select("page_id", "det_no", "type", "source", F.array_join("sources", ",").alias("sources"), "confidence", merge.masked(F.col("text")).alias("text"))


@query()
def inspector_views(spark, sf_dir):
    """Detections of each inspector view, counted by type."""
    return merge.views(_both(spark, sf_dir)).groupBy("view", "type").agg(F.count(F.lit(1)).alias("n"))


#: Form fields by arithmetic on orders, in SQL that both engines read.
_FIELD = {
    "el_idx": "o_orderkey", "id": "CASE o_custkey % 5 WHEN 0 THEN 'user-pin' WHEN 1 THEN 'f1' WHEN 2 THEN 'Zip-Code' ELSE concat('x', o_orderkey % 10) END", "type": "CASE o_orderkey % 7 WHEN 0 THEN 'password' WHEN 1 THEN 'email' WHEN 2 THEN 'TEXT' END",
    "label_text": "CASE o_custkey % 9 WHEN 0 THEN 'Card-number' WHEN 1 THEN 'Passport' WHEN 2 THEN 'Full-name' WHEN 3 THEN '' WHEN 4 THEN 'Street-Address' WHEN 5 THEN 'Search' WHEN 6 THEN 'IBAN code' END",
    "name": "CASE o_orderkey % 11 WHEN 0 THEN 'iban' WHEN 1 THEN 'first_name' WHEN 2 THEN 'q' WHEN 3 THEN 'SSN' WHEN 4 THEN 'login' WHEN 5 THEN 'bank_acc' WHEN 6 THEN 'cc_num' END",
    "autocomplete": "CASE o_orderkey % 13 WHEN 0 THEN 'cc-number' WHEN 1 THEN 'name' WHEN 2 THEN 'billing street-address' WHEN 3 THEN 'new-password' WHEN 4 THEN 'given-name' ELSE 'off' END",
    "value": "CASE o_custkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Al' WHEN 2 THEN '  ' END", "placeholder": "CASE WHEN o_orderkey % 3 = 0 THEN 'Your Text' END",
}


def _fields_sql() -> str:
    made = ", ".join(f"{x} \"{c}\"" for c, x in _FIELD.items())
    has = lambda words: " OR ".join(f"contains(a, '{w}')" for w in words) or "false"
    said = lambda what: f"regexp_matches(said, '{fields.WORDS[what]}')"
    items = [
        f"CASE WHEN ({has(autos)} OR {said(what)}) AND (v <> '' OR p <> '') THEN {{'kind': '{what}', 'value': CASE WHEN v <> '' THEN v ELSE '[{title}: ' || CASE WHEN p <> '' THEN p ELSE n END || ']' END, 'confidence': {confidence}::DOUBLE}} END"
        for what, (title, confidence, autos) in fields.FILLS.items()
    ]
    items.append(f"CASE WHEN (a IN ('name', 'given-name', 'family-name') OR {said('NAME')}) AND length(v) > 2 THEN {{'kind': 'NAME', 'value': v, 'confidence': 0.86::DOUBLE}} END")
    return (
        f"WITH e AS (SELECT {made} FROM orders), l AS (SELECT el_idx, lower(coalesce(\"type\", '')) k, lower(coalesce(autocomplete, '')) a, lower(coalesce(\"name\", '')) n, lower(coalesce(id, '')) i, lower(coalesce(placeholder, '')) p, trim(coalesce(\"value\", '')) v, coalesce(label_text, '') b FROM e),"
        "s AS (SELECT *, n || ' ' || i || ' ' || p || '   ' || b said, substr(CASE WHEN b <> '' THEN b WHEN p <> '' THEN p ELSE n END, 1, 80) context FROM l),"
        f"f AS (SELECT el_idx, context, CASE WHEN k = 'password' OR contains(a, 'password') OR {said('PASSWORD')} THEN [{{'kind': 'PASSWORD', 'value': CASE WHEN v <> '' THEN '{fields.MASK}' ELSE '[Password Input: ' || CASE WHEN p <> '' THEN p WHEN n <> '' THEN n WHEN i <> '' THEN i ELSE 'masked' END || ']' END, 'confidence': 0.99::DOUBLE}}]"
        f" ELSE list_filter([{', '.join(items)}], lambda x: x IS NOT NULL) END d FROM s),"
        "r AS (SELECT el_idx, context, unnest(range(0, len(d)))::INTEGER det_no, unnest(d) d FROM f)"
        "SELECT el_idx, det_no, d.kind kind, d.\"value\" \"value\", d.confidence confidence, context FROM r"
    )


@query(_fields_sql())
def field_heuristics(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(*(F.expr(x).alias(c) for c, x in _FIELD.items()))
    told = F.map_from_arrays(F.array(*(F.lit(k) for k in ("name", "autocomplete", "value", "placeholder"))), F.array("name", "autocomplete", "value", "placeholder"))
    e = e.select("el_idx", "id", "type", "label_text", told.alias("attributes"))
    return fields.field_detections(e).select("el_idx", "det_no", "kind", "value", "confidence", "context")


@query()
def page_scan(spark, sf_dir):
    """Elements and static text of all pages, scanned and merged; boxes are unknown, so that nothing of different places merges."""
    found = detect.scan_rows(pages.taken(pages.judged(pages.rows(table(spark, sf_dir, "pages"))), prefilter))
    return found.select("page_id", "det_no", "type", "text", "source", "selector", "confidence")


@query()
def page_payload(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    none = F.lit(None).cast(merge.BOX)
    e = pages.elements(p).withColumn("bbox", none)
    both = detect.payload(p.select("page_id", "url"), e, detect.scan(e))
    return both.select("page_id", "url", F.coalesce(F.size("elements"), F.lit(0)).alias("n_elements"), F.coalesce(F.size("detections"), F.lit(0)).alias("n_detections"))


@query(
    f"{_merge_sql()} SELECT page_id, det_no, r.source layer, r.\"type\" \"type\", r.\"type\" || ' · ' || {_SOURCES.format('+')} || ' · ' || substr(r.text, 1, 6) || '…' label, greatest(0, r.l) \"left\", greatest(0, r.t) top, greatest(1, r.w) width, greatest(1, r.h) height FROM m"
)
def detection_overlay(spark, sf_dir):
    return detect.overlay(merge.merge_sources(_made_detections(spark, sf_dir)))


# ---------------------------------------------------------------- sanitiser


@query(f"WITH {O.sanitized('SELECT doc_id k, text FROM documents')} SELECT k doc_id, t sanitized, masked::INTEGER masked_count, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') entities FROM s")
def sanitize_documents(spark, sf_dir):
    s = sanitize.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return s.select("doc_id", "sanitized", "masked_count", F.array_join("entities", "|").alias("entities"))


ORACLE_SQL["streamed_sanitize"] = ORACLE_SQL["sanitize_documents"]


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    source = table(spark, sf_dir, "documents")
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="stream-")
    base = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def step(d: DataFrame) -> DataFrame:
        s = sanitize.sanitize(d.select("doc_id", "text"))
        return s.select("doc_id", "sanitized", "masked_count", F.array_join("entities", "|").alias("entities"))

    return stream.run(spark, f"{sf_dir}/documents.parquet*", source.schema, step, f"{base}/out", f"{base}/checkpoint")


QUERIES["streamed_sanitize"] = _streamed


@query(
    f"WITH {O.sanitized('SELECT doc_id k, text, source FROM documents')} SELECT k doc_id, 'Safe Local Summary for \"' || coalesce(nullif(source, ''), 'Current Webpage') || '\":\n• Privacy Shield Status: Verified (All PII filtered)\n• Core Content: '"
    " || CASE WHEN t <> '' THEN substr(t, 1, 300) || '...' ELSE 'Clean context extracted.' END || '\n• Detected entities removed: ' || CASE WHEN len(every) > 0 THEN array_to_string(every, ', ') ELSE 'None' END result FROM s"
)
def summarize_documents(spark, sf_dir):
    s = sanitize.sanitize(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return s.select("doc_id", sanitize.summary(F.col("source")).alias("result"))


@query(
    f"WITH {O.sanitized('SELECT page_id k, url text FROM pages')}, u AS (SELECT k page_id, coalesce(text, '') url, every, masked, starts_with(coalesce(text, ''), 'https://') is_https, regexp_matches(coalesce(text, ''), {O.pattern(sanitize.TRACKER)}) has_tracker FROM s)"
    "SELECT page_id, is_https, has_tracker, 'Security Audit for: ' || url || '\n• Protocol: ' || CASE WHEN is_https THEN '🔒 Secure HTTPS' ELSE '⚠️ Unencrypted HTTP' END || '\n• URL Tracking Parameters: ' ||"
    " CASE WHEN has_tracker THEN 'Detected & Stripped' ELSE 'None detected' END || '\n• PII Exposure Risk: ' || CASE WHEN len(every) > 0 THEN 'High (Masked ' || masked || ' tokens)' ELSE 'Low (Safe)' END result FROM u"
)
def audit_urls(spark, sf_dir):
    s = sanitize.sanitize(table(spark, sf_dir, "pages").select("page_id", "url"), "url")
    return s.select("page_id", sanitize.is_https(F.col("url")).alias("is_https"), sanitize.has_tracker(F.col("url")).alias("has_tracker"), sanitize.audit(F.col("url")).alias("result"))


_HAS = lambda words: " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words)


@query(
    f"SELECT conv_id, turn, CASE WHEN {_HAS(sanitize.SUMMARY_WORDS)} THEN 'SUMMARIZE_LOCAL' WHEN {_HAS(sanitize.AUDIT_WORDS)} THEN 'ANALYZE_SECURITY' ELSE 'SANITIZE_PII' END action,"
    "coalesce(text, '') || '\n\nContext:\n' || coalesce(nullif(role, ''), '') request FROM conversations"
)
def route_prompts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", sanitize.route(F.col("text")).alias("action"), sanitize.request_text(F.col("text"), F.lit(None), F.col("role")).alias("request"))


@query(
    f"WITH {O.sanitized('SELECT conv_id * 1000 + turn k, conv_id, role, text FROM conversations')}, r AS (SELECT *, CASE WHEN {_HAS(sanitize.SUMMARY_WORDS)} OR conv_id % 5 = 0 THEN 'SUMMARIZE_LOCAL' WHEN {_HAS(sanitize.AUDIT_WORDS)} OR conv_id % 5 = 1 THEN 'ANALYZE_SECURITY' ELSE 'SANITIZE_PII' END action,"
    " CASE WHEN conv_id % 2 = 0 THEN 'https' ELSE 'http' END || '://x.org/?trk=' || conv_id url FROM s)"
    "SELECT k req_id, action, true success, CASE action WHEN 'SUMMARIZE_LOCAL' THEN 'Safe Local Summary for \"' || coalesce(nullif(role, ''), 'Current Webpage') || '\":\n• Privacy Shield Status: Verified (All PII filtered)\n• Core Content: '"
    " || CASE WHEN t <> '' THEN substr(t, 1, 300) || '...' ELSE 'Clean context extracted.' END || '\n• Detected entities removed: ' || CASE WHEN len(every) > 0 THEN array_to_string(every, ', ') ELSE 'None' END"
    " WHEN 'ANALYZE_SECURITY' THEN 'Security Audit for: ' || url || '\n• Protocol: ' || CASE WHEN conv_id % 2 = 0 THEN '🔒 Secure HTTPS' ELSE '⚠️ Unencrypted HTTP' END || '\n• URL Tracking Parameters: Detected & Stripped\n• PII Exposure Risk: ' ||"
    " CASE WHEN len(every) > 0 THEN 'High (Masked ' || masked || ' tokens)' ELSE 'Low (Safe)' END ELSE t END result, masked::INTEGER masked_count, array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), '|') detected_entities, 0.99::DOUBLE confidence_score FROM r"
)
def responses(spark, sf_dir):
    """What every turn of a conversation gets as a request."""
    c = table(spark, sf_dir, "conversations")
    fifth = F.col("conv_id") % 5
    routed = sanitize.route(F.col("text"))
    action = F.when((routed == "SUMMARIZE_LOCAL") | (fifth == 0), "SUMMARIZE_LOCAL").when((routed == "ANALYZE_SECURITY") | (fifth == 1), "ANALYZE_SECURITY").otherwise("SANITIZE_PII")
    url = F.concat(F.when(F.col("conv_id") % 2 == 0, "https").otherwise("http"), F.lit("://x.org/?trk="), F.col("conv_id").cast("string"))
    r = sanitize.respond(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("req_id"), action.alias("action"), "text", F.col("role").alias("title"), url.alias("url")))
    return r.drop("title", "url").withColumn("detected_entities", F.array_join("detected_entities", "|"))


#: Tabs of 40 sessions; some windows show no web page, some sessions have no focused or no active tab.
_TABS = (
    "SELECT page_id % 40 session_id, page_id tab_no, CASE WHEN page_id % 4 = 0 THEN 'about:newtab' ELSE url END url, 'Tab ' || page_id title,"
    " page_id % 3 = 0 AND page_id % 40 <> 7 active, page_id % 40 % 2 = 0 AND page_id % 5 = 0 focused FROM pages"
)


@query(
    f"WITH t AS ({_TABS}), f AS (SELECT session_id, min(tab_no) FILTER (focused) a, min(tab_no) FILTER (starts_with(url, 'http://') OR starts_with(url, 'https://')) b, min(tab_no) c FROM t WHERE active GROUP BY 1),"
    "s AS (SELECT DISTINCT session_id FROM t) SELECT s.session_id, t.tab_no, coalesce(t.title, 'No active tab') title, CASE WHEN f.session_id IS NULL THEN 'about:blank' ELSE t.url END url"
    " FROM s LEFT JOIN f USING (session_id) LEFT JOIN t ON t.session_id = s.session_id AND t.tab_no = coalesce(f.a, f.b, f.c)"
)
def active_tabs(spark, sf_dir):
    t = table(spark, sf_dir, "pages").selectExpr(
        "page_id % 40 AS session_id", "page_id AS tab_no", "CASE WHEN page_id % 4 = 0 THEN 'about:newtab' ELSE url END AS url", "concat('Tab ', page_id) AS title",
        "page_id % 3 = 0 AND page_id % 40 <> 7 AS active", "page_id % 40 % 2 = 0 AND page_id % 5 = 0 AS focused",
    )
    return sanitize.active_tab(t).select("session_id", "tab_no", "title", "url")


# ---------------------------------------------------------------- pages


#: All links of these pages stand in list items of one navigation; ids and places follow.
@query(
    "WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">([^<]*)</a>', 1) t FROM pages), e AS (SELECT page_id, unnest(range(0, len(t)))::INTEGER el_idx, unnest(t) t FROM p)"
    "SELECT page_id, el_idx, 'kw-el-' || el_idx id, 'a' tag_name, NULL::VARCHAR \"type\", NULL::VARCHAR \"role\", CASE WHEN length(t) > 120 THEN substr(t, 1, 117) || '...' ELSE t END \"text\", NULL::VARCHAR label_text,"
    " 'body:nth-of-type(1) > nav:nth-of-type(1) > ul:nth-of-type(1) > li:nth-of-type(' || el_idx + 1 || ') > a:nth-of-type(1)' selector, '/html[1]/body[1]/nav[1]/ul[1]/li[' || el_idx + 1 || ']/a[1]' xpath FROM e"
)
def page_elements(spark, sf_dir):
    return pages.elements(table(spark, sf_dir, "pages")).drop("attributes")


@query(
    "WITH p AS (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) h FROM pages) SELECT page_id, unnest(range(0, len(h)))::INTEGER n, unnest(h) href FROM p"
)
def page_links(spark, sf_dir):
    links = pages.candidates(table(spark, sf_dir, "pages")).where("tag_name = 'a'")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("page_id").orderBy("el_idx")) - 1
    return links.select("page_id", n.alias("n"), F.col("attributes").getItem("href").alias("href"))


@query("SELECT page_id, count(*)::BIGINT total FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(a|input|button|select|textarea|img)[ >]')) FROM pages) GROUP BY page_id")
def page_audit(spark, sf_dir):
    return pages.audit(table(spark, sf_dir, "pages")).select("page_id", "total")


@query(
    "SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '(?i)<input[\\s/>]'))::BIGINT field_count, '🔒 Privacy audit complete: ' || len(regexp_extract_all(coalesce(html, ''), '(?i)<input[\\s/>]')) || ' input field(s) analyzed.' message FROM pages"
)
def page_inputs(spark, sf_dir):
    return pages.count_inputs(table(spark, sf_dir, "pages"))


@query()
def page_static_nodes(spark, sf_dir):
    s = pages.static_nodes(table(spark, sf_dir, "pages"), prefilter)
    return s.withColumn("matched_patterns", F.array_join("matched_patterns", ","))


@query()
def page_context(spark, sf_dir):
    c = pages.context(table(spark, sf_dir, "pages"))
    return c.withColumn("headings", F.array_join("headings", "\n"))


@query("SELECT page_id, (len(regexp_extract_all(html, '<h[12][ >]')))::INTEGER n_headings FROM pages")
def page_headings(spark, sf_dir):
    c = pages.context(table(spark, sf_dir, "pages"))
    return c.select("page_id", F.size("headings").alias("n_headings"))


# ---------------------------------------------------------------- recognised words

_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversation turns on a grid of eight a line."""
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return _on_grid(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("frame_id"), "text"))


def _lines_on_grid(texts: DataFrame) -> DataFrame:
    """Lines of the words that ``_on_grid`` gives; texts are shuffled, not words, and a frame's words come one after another."""
    return lines.group_lines(_on_grid(texts.repartition("frame_id").sortWithinPartitions("frame_id")), together=True)


def _on_grid(texts: DataFrame) -> DataFrame:
    words = F.array_remove(F.split("text", r"\s+"), "")
    w = texts.select("frame_id", F.posexplode(words).alias("token_no", "text"))
    n, k = (F.col("token_no") / 8).cast("int"), F.col("token_no") % 8
    return w.select("frame_id", F.col("token_no").cast("long"), "text", (k * 100.0).alias("left"), (n * 30.0 + k).alias("top"), F.lit(60.0).alias("width"), F.lit(12.0).alias("height"), F.lit(90.0).alias("confidence"))


@query(
    f"WITH w AS (SELECT conv_id * 1000 + turn frame_id, unnest(range(0, len({_WORDS}))) n, unnest({_WORDS}) w FROM conversations WHERE text IS NOT NULL)"
    "SELECT frame_id, (n // 8)::INTEGER line_no, string_agg(w, ' ' ORDER BY n) text FROM w GROUP BY ALL"
)
def ocr_lines(spark, sf_dir):
    return lines.group_lines(_grid(spark, sf_dir)).select("frame_id", "line_no", "text")


@query(
    f"WITH w AS (SELECT conv_id * 1000 + turn frame_id, unnest(range(0, len({_WORDS}))) n, unnest({_WORDS}) w FROM conversations WHERE text IS NOT NULL)"
    "SELECT frame_id, (n // 8)::INTEGER line_no, min((n % 8) * 100.0) \"left\", min(n // 8 * 30.0 + n % 8) top, max((n % 8) * 100.0 + 60) - min((n % 8) * 100.0) width,"
    "max(n // 8 * 30.0 + n % 8 + 12) - min(n // 8 * 30.0 + n % 8) height FROM w WHERE n % 8 IN (1, 2) GROUP BY ALL"
)
def span_boxes(spark, sf_dir):
    """The box around the second and third word of each line, if it has a second."""
    found = lines.group_lines(_grid(spark, sf_dir)).where(F.size("spans") > 1)
    last = F.when(F.size("spans") > 2, F.col("spans")[2]["end"]).otherwise(F.col("spans")[1]["end"])
    b = lines.span_box(F.col("spans"), F.col("spans")[1]["start"], last, G.box(*(F.col(c) for c in ("left", "top", "width", "height"))))
    return found.select("frame_id", "line_no", b.alias("b")).select("frame_id", "line_no", "b.*")


@query()
def ocr_lenient(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.sql(X.texts_sql(X.LOOSE_TEXTS)).select(F.col("doc_id").cast("long"), "text"))
    return scan.scan_text(docs, lenient=True)


@query(
    f"WITH w AS (SELECT conv_id * 1000 + turn frame_id, unnest(range(0, len({_WORDS}))) n, unnest({_WORDS}) w FROM conversations WHERE text IS NOT NULL),"
    "l AS (SELECT frame_id, n // 8 l, string_agg(w, ' ' ORDER BY n) t FROM w GROUP BY ALL) SELECT frame_id, string_agg(t, '\n' ORDER BY l) full_text FROM l GROUP BY frame_id"
)
def ocr_full_text(spark, sf_dir):
    return lines.full_text(lines.group_lines(_grid(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2 >= 80 THEN 'high' WHEN l_quantity * 2 >= 50 THEN 'medium' ELSE 'low' END band FROM lineitem WHERE l_quantity * 2 >= 30")
def confidence_bands(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("confidence"), F.lit("x").alias("text"))
    return lines.sure_words(w).select("l_orderkey", "l_linenumber", lines.confidence_band(F.col("confidence")).alias("band"))


@query(
    "WITH v AS (SELECT vec_id, (floor(greatest(0, least(255, (unnest(embedding)::DOUBLE + 1) * 127.5))))::INTEGER v FROM embeddings), c AS (SELECT vec_id, v, count(*) n FROM v GROUP BY ALL),"
    "w AS (SELECT *, sum(n) OVER (PARTITION BY vec_id ORDER BY v) upto, sum(n) OVER (PARTITION BY vec_id) total FROM c),"
    "h AS (SELECT vec_id, min(v) FILTER (upto >= total * 0.02::DOUBLE) low, min(v) FILTER (upto >= total * 0.98::DOUBLE) high FROM w GROUP BY vec_id)"
    "SELECT vec_id, low, high, v, greatest(0, least(255, (v - low) * (255.0::DOUBLE / greatest(high - low, 1)))) stretched, n::BIGINT n FROM w JOIN h USING (vec_id)"
)
def histogram_stretch(spark, sf_dir):
    px = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return lines.stretch(px.select("vec_id", ((F.col("x").cast("double") + 1) * 127.5).alias("luma")), "vec_id")


@query("SELECT l_orderkey, coalesce(list_sort(list(l_quantity))[(count(l_quantity) // 2 + 1)::BIGINT], 0.0) median_quantity FROM lineitem GROUP BY l_orderkey")
def upper_median(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.upper_median(F.col("l_quantity")).alias("median_quantity"))


# ---------------------------------------------------------------- boxes

_BOXES = "SELECT l_orderkey frame_id, l_linenumber box_no, (l_quantity * 4)::DOUBLE l, (l_partkey % 50)::DOUBLE t, 100.0::DOUBLE w, 60.0::DOUBLE h, round(1 - l_discount - l_linenumber / 1000, 6) score, l_returnflag kind FROM lineitem"
_IW = "(least(a.l + a.w, b.l + b.w) - greatest(a.l, b.l))"
_IH = "(least(a.t + a.h, b.t + b.h) - greatest(a.t, b.t))"
_IOU = f"CASE WHEN {_IW} <= 0 OR {_IH} <= 0 THEN 0.0::DOUBLE ELSE {_IW} * {_IH} / (a.w * a.h + b.w * b.h - {_IW} * {_IH}) END"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    b = G.box(F.col("l_quantity") * 4, (F.col("l_partkey") % 50).cast("double"), F.lit(100.0), F.lit(60.0))
    score = F.round(1 - F.col("l_discount") - F.col("l_linenumber") / 1000, 6)
    return li.select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_no"), b.alias("bbox"), score.alias("score"), F.col("l_returnflag").alias("kind"))


_T = "STRUCT(box_no INTEGER, l DOUBLE, t DOUBLE, w DOUBLE, h DOUBLE, score DOUBLE, kind VARCHAR)"


@query(
    f"WITH x AS ({_BOXES}), g AS (SELECT frame_id, list([{{'box_no': box_no, 'l': l, 't': t, 'w': w, 'h': h, 'score': score, 'kind': kind}}::{_T}] ORDER BY score DESC, box_no, l, t, w, h, kind) d FROM x GROUP BY frame_id),"
    f"k AS (SELECT frame_id, unnest(list_reduce(list_prepend([]::{_T}[], d), lambda acc, x: CASE WHEN len(list_filter(acc, lambda a: a.kind = x[1].kind AND "
    + _IOU.replace("b.", "x[1].")
    + " > 0.45)) > 0 THEN acc ELSE list_concat(acc, x) END)) r FROM g) SELECT frame_id, r.box_no box_no, r.score score FROM k"
)
def nms(spark, sf_dir):
    return vision.suppress(_boxes(spark, sf_dir), "frame_id", "kind", "score", vision.OBJECT["iou"]).select("frame_id", "box_no", "score")


def _pairs(spark: SparkSession, sf_dir: str, of, name: str) -> DataFrame:
    x = _boxes(spark, sf_dir)
    a, b = x.select("frame_id", F.col("box_no").alias("a"), F.col("bbox").alias("_a")), x.select("frame_id", F.col("box_no").alias("b"), F.col("bbox").alias("_b"))
    return a.join(b, "frame_id").where("a < b").select("frame_id", "a", "b", of(F.col("_a"), F.col("_b")).alias(name)).where(F.col(name) > 0)


@query(f"WITH x AS ({_BOXES}) SELECT * FROM (SELECT a.frame_id, a.box_no a, b.box_no b, {_IOU} iou FROM x a JOIN x b ON a.frame_id = b.frame_id AND a.box_no < b.box_no) WHERE iou > 0")
def iou_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, G.iou, "iou")


@query(
    f"WITH x AS ({_BOXES}) SELECT * FROM (SELECT a.frame_id, a.box_no a, b.box_no b, CASE WHEN {_IW} <= 0 OR {_IH} <= 0 THEN 0.0::DOUBLE ELSE {_IW} * {_IH} / least(a.w * a.h, b.w * b.h) END overlap FROM x a JOIN x b ON a.frame_id = b.frame_id AND a.box_no < b.box_no) WHERE overlap > 0"
)
def overlap_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir, G.overlap_ratio, "overlap")


_REGION = "SELECT p_partkey, (p_size * 40)::DOUBLE w, (p_partkey % 700 + 20)::DOUBLE h FROM part"


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    b = G.box(F.lit(5.0), F.lit(7.0), (F.col("p_size") * 40).cast("double"), (F.col("p_partkey") % 700 + 20).cast("double"))
    return p.select("p_partkey", b.alias("b"))


@query(
    f"WITH r AS ({_REGION}), s AS (SELECT *, least(640 / w, 640 / h) scale FROM r), c AS (SELECT *, (640 - w * scale) / 2 pad_x, (640 - h * scale) / 2 pad_y, w * scale cw, h * scale ch FROM s),"
    "m AS (SELECT *, 0.25 * 640 - pad_x x0, 0.25 * 640 - pad_y y0, 0.75 * 640 - pad_x x1, 0.75 * 640 - pad_y y1 FROM c), n AS (SELECT *, greatest(0, least(cw, x0)) / scale a, greatest(0, least(ch, y0)) / scale b,"
    "greatest(0, least(cw, x1)) / scale c, greatest(0, least(ch, y1)) / scale d FROM m WHERE x1 > 0 AND y1 > 0 AND x0 < cw AND y0 < ch)"
    "SELECT p_partkey, scale, pad_x, pad_y, 5 + a \"left\", 7 + b top, c - a width, d - b height FROM n WHERE c - a > 1 AND d - b > 1"
)
def letterbox(spark, sf_dir):
    r = _regions(spark, sf_dir)
    quarter = [F.lit(v) for v in (0.25, 0.25, 0.75, 0.75)]
    r = r.select("p_partkey", G.letterbox(F.col("b"), 640.0).alias("f"), G.unletterboxed(*quarter, F.col("b"), 640.0).alias("m")).where("m is not null")
    return r.select("p_partkey", "f.scale", "f.pad_x", "f.pad_y", "m.left", "m.top", "m.width", "m.height")


_AXIS = lambda n: f"CASE WHEN {n} <= 384 THEN [0.0::DOUBLE] ELSE list_append(list_transform(range(0, ceil(({n} - 384) / 288)::BIGINT), lambda i: i * 288.0::DOUBLE), {n} - 384) END"


@query(
    f"WITH r AS ({_REGION}), a AS (SELECT p_partkey frame_id, w, h, {_AXIS('w')} xs, {_AXIS('h')} ys FROM r), y AS (SELECT *, unnest(ys) y FROM a), x AS (SELECT *, unnest(xs) x FROM y),"
    "n AS (SELECT *, (row_number() OVER (PARTITION BY frame_id ORDER BY y, x) - 1)::INTEGER tile_no FROM x) SELECT frame_id, tile_no, x \"left\", y top, least(384, w) width, least(384, h) height FROM n WHERE tile_no < 24"
)
def tiles(spark, sf_dir):
    r = _regions(spark, sf_dir).select(F.col("p_partkey").alias("frame_id"), "b.width", "b.height")
    return vision.tiles(r, 384.0, 0.25).select("frame_id", "tile_no", "bbox.*")


@query(f"WITH r AS ({_REGION}) SELECT p_partkey, greatest(0.5, least(4, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 7 + 0.25 ELSE 2800 / greatest(w, h) END)) scale FROM r")
def scale_choice(spark, sf_dir):
    asked = F.when(F.col("p_partkey") % 3 == 0, F.col("p_partkey") % 7 + 0.25)
    return _regions(spark, sf_dir).select("p_partkey", G.read_scale(asked, F.col("b.width"), F.col("b.height")).alias("scale"))


_CUT = lambda v, hi: f"greatest(0, least({hi}, floor({v} + 0.5)))"


@query(
    f"WITH x AS ({_BOXES}), v AS (SELECT frame_id, box_no, {_CUT('l - 60.5', '150')} a, {_CUT('t - 10.5', '80')} b, {_CUT('l - 60.5 + w', '150')} c, {_CUT('t - 10.5 + h', '80')} d FROM x)"
    "SELECT frame_id, box_no, a \"left\", b top, greatest(c - a, 0) width, greatest(d - b, 0) height FROM v"
)
def viewport_boxes(spark, sf_dir):
    b = F.col("bbox")
    moved = G.box(b["left"] - 60.5, b["top"] - 10.5, b["width"], b["height"])
    v = G.viewport_box(moved, F.lit(150.0), F.lit(80.0))
    return _boxes(spark, sf_dir).select("frame_id", "box_no", v.alias("v")).select("frame_id", "box_no", "v.*")


_LABELS = ", ".join(f"({k}, '{v}')" for k, v in vision.CLASS_LABELS.items())


@query(
    f"WITH l(i, label) AS (VALUES {_LABELS}), s AS (SELECT vec_id, list_max(embedding)::DOUBLE m, list_position(embedding, list_max(embedding)) - 1 i FROM embeddings)"
    "SELECT vec_id, s.i::INTEGER class_idx, floor(m * 1000 + 0.5) / 1000 score, coalesce(label, 'ui_element') label FROM s LEFT JOIN l USING (i) WHERE m > 0.25 AND (label IS NOT NULL OR m > 0.35)"
)
def argmax_label(spark, sf_dir):
    known = spark.createDataFrame(list(vision.CLASS_LABELS.items()), "class_idx int, label string")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("scores"))
    return vision.decode_classes(e, known).select("vec_id", "class_idx", "score", "label")


@query(
    "SELECT vec_id, greatest(0, least(1, embedding[1]::DOUBLE + 0.4)) x0, greatest(0, least(1, embedding[2]::DOUBLE + 0.4)) y0, greatest(0, least(1, embedding[3]::DOUBLE + 0.6)) x1, greatest(0, least(1, embedding[4]::DOUBLE + 0.6)) y1 FROM embeddings"
    " WHERE embedding[5]::DOUBLE + 0.5 >= 0.5 AND embedding[3]::DOUBLE + 0.6 > embedding[1]::DOUBLE + 0.4 AND embedding[4]::DOUBLE + 0.6 > embedding[2]::DOUBLE + 0.4"
)
def face_rows(spark, sf_dir):
    x = lambda i, d: F.col("embedding")[i].cast("double") + d
    raw = table(spark, sf_dir, "embeddings").select("vec_id", x(0, 0.4).alias("x0"), x(1, 0.4).alias("y0"), x(2, 0.6).alias("x1"), x(3, 0.6).alias("y1"), x(4, 0.5).alias("score"))
    return vision.valid_faces(raw).drop("score")


# ---------------------------------------------------------------- inventories


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rel = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 11 == 0, ".PNG").otherwise(".txt"))
    text = F.coalesce("text", F.lit(""))
    return d.select(F.col("doc_id"), rel.alias("rel"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256")).withColumn("binary", inventory.is_binary(F.col("rel")))


_FILES = "SELECT doc_id, source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.PNG' ELSE '.txt' END rel, strlen(coalesce(text, '')) size, sha256(coalesce(text, '')) sha256, doc_id % 11 = 0 bin FROM documents"


@query(
    f"WITH f AS ({_FILES}) SELECT rel, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 7 = 1 THEN 'removed' ELSE 'modified' END change FROM f WHERE doc_id % 7 < 3"
)
def snapshot_diff(spark, sf_dir):
    f = _files(spark, sf_dir)
    before = f.where("doc_id % 7 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 7 == 2, F.sha2("rel", 256)).otherwise(F.col("sha256")))
    return inventory.diff(before, f.where("doc_id % 7 <> 1"))


@query(
    f"WITH f AS ({_FILES}) SELECT rel, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(size / 1048576.0 * 100 + 0.5) / 100) END size_text, substr(sha256, 1, 16) digest,"
    "CASE WHEN bin THEN 'binary' WHEN size < 122880 THEN 'embedded' ELSE 'generated' END kind FROM f"
)
def file_inventory(spark, sf_dir):
    return inventory.inventory(_files(spark, sf_dir))


@query(
    f"WITH f AS ({_FILES}) SELECT rel, CASE WHEN rel = 'src1/en/1.txt' THEN 'The one' WHEN starts_with(rel, 'src1/') THEN 'First' WHEN starts_with(rel, 'src1') THEN 'Ones' WHEN bin THEN 'Binary asset.' WHEN starts_with(rel, 'src2/de/') THEN 'German' WHEN starts_with(rel, 'src2/') THEN 'Second' ELSE 'Project file.' END purpose FROM f"
)
def file_purposes(spark, sf_dir):
    two = "path string, purpose string"
    exact = spark.createDataFrame([("src1/en/1.txt", "The one")], two)
    folders = spark.createDataFrame([("src2", "Second"), ("src2/de", "German")], two)
    prefixes = spark.createDataFrame([(0, "src1/", "First"), (1, "src1", "Ones")], "no int, prefix string, purpose string")
    return inventory.purposes(_files(spark, sf_dir).select("rel", "binary"), exact, prefixes, folders).select("rel", "purpose")


@query("SELECT page_id, greatest(3, coalesce(list_max(list_transform(regexp_extract_all(replace(html, '*', '`'), '`+'), lambda x: length(x))), 0) + 1)::INTEGER fence FROM pages")
def fence_lengths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", inventory.fence_length(F.translate("html", "*", "`")).alias("fence"))


@query("SELECT * EXCLUDE (n) FROM (SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) n FROM documents) WHERE n <= 12")
def capped_top_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return inventory.capped(d, "source", [F.col("n_chars").desc(), F.col("doc_id")], 12)


@query(
    "SELECT * FROM (SELECT user_id::BIGINT \"at\", count(*) FILTER (event_id % 3 = 0)::BIGINT n_added, count(*) FILTER (event_id % 3 = 1)::BIGINT n_modified, count(*) FILTER (event_id % 3 = 2)::BIGINT n_removed FROM events GROUP BY user_id"
    " UNION ALL SELECT 999999999, count(*) FILTER (doc_id % 7 = 0), count(*) FILTER (doc_id % 7 = 2), count(*) FILTER (doc_id % 7 = 1) FROM documents) ORDER BY \"at\" DESC LIMIT 60"
)
def changelog(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = lambda k, name: F.count_if(F.col("event_id") % 3 == k).alias(name)
    entries = e.groupBy(F.col("user_id").alias("at")).agg(n(0, "n_added"), n(1, "n_modified"), n(2, "n_removed"))
    return inventory.changelog(entries, snapshot_diff(spark, sf_dir), F.lit(999999999).cast("long"))


@query("SELECT count(*)::BIGINT n_files, sum(strlen(coalesce(text, '')))::BIGINT total_bytes FROM documents")
def total_bytes(spark, sf_dir):
    return _files(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))


# ---------------------------------------------------------------- more of boxes, words and tabs


@query(
    f"WITH x AS ({_BOXES}) SELECT frame_id, box_no, l / 800 * 100 \"left\", t / 600 * 100 top, w / 800 * 100 width, h / 600 * 100 height FROM x WHERE w >= 80 AND h >= 16"
)
def percent_boxes(spark, sf_dir):
    b = _boxes(spark, sf_dir).where(G.at_least(F.col("bbox"), 16.0) & (F.col("bbox.width") >= 80))
    return b.select("frame_id", "box_no", G.percent_of(F.col("bbox"), F.lit(800.0), F.lit(600.0)).alias("v")).select("frame_id", "box_no", "v.*")


@query(
    f"WITH x AS ({_BOXES}) SELECT frame_id, box_no, floor(l * 0.37::DOUBLE + 3.5 + 0.5) \"left\", floor(t * 0.41::DOUBLE - 2.25 + 0.5) top, floor(w * 0.37::DOUBLE + 0.5) width, floor(h * 0.41::DOUBLE + 0.5) height FROM x"
)
def scaled_boxes(spark, sf_dir):
    v = G.scaled(F.col("bbox"), F.lit(0.37), F.lit(0.41), F.lit(3.5), F.lit(-2.25))
    return _boxes(spark, sf_dir).select("frame_id", "box_no", v.alias("v")).select("frame_id", "box_no", "v.*")


@query("SELECT l_orderkey, coalesce(avg(l_quantity) FILTER (l_quantity > 20), 0.0::DOUBLE) mean_confidence, count(*) FILTER (l_quantity > 20)::BIGINT n_crops FROM lineitem GROUP BY l_orderkey")
def crop_confidence(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 20, F.col("l_quantity")).alias("confidence"))
    return lines.mean_confidence(c, "l_orderkey")


@query(
    f"WITH w AS (SELECT conv_id * 1000 + turn frame_id, unnest(range(0, len({_WORDS}))) token_no, unnest({_WORDS}) text FROM conversations WHERE text IS NOT NULL) SELECT frame_id, token_no, text FROM w WHERE contains(lower(text), 'th')"
)
def word_search(spark, sf_dir):
    return lines.search_words(_grid(spark, sf_dir), " Th ").select("frame_id", "token_no", "text")


@query("SELECT frame_id, count(*) FILTER (kind = 'A')::BIGINT n_faces, count(*) FILTER (kind <> 'A')::BIGINT n_objects FROM (" + _BOXES + ") GROUP BY frame_id")
def label_counts(spark, sf_dir):
    b = _boxes(spark, sf_dir).withColumn("label", F.when(F.col("kind") == "A", "face").otherwise("card"))
    return vision.counts_by_label(b)


@query("SELECT page_id tab_id, url, coalesce(CASE WHEN page_id % 2 = 0 THEN 'page ' || page_id END, 'tab ' || page_id) title, CASE WHEN page_id % 2 = 0 THEN page_id % 5 END n FROM pages")
def tab_overlay(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    name = lambda x: F.concat(F.lit(x), F.col("page_id").cast("string"))
    tabs = p.select(F.col("page_id").alias("tab_id"), "url", name("tab ").alias("title"))
    said = p.where("page_id % 2 = 0").select(F.col("page_id").alias("tab_id"), name("page ").alias("title"), (F.col("page_id") % 5).alias("n"))
    return pages.overlaid(tabs, said)


@query(
    f"WITH f AS ({_FILES}) SELECT '| `' || rel || '` | ' || CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', floor(size / 1024.0 * 10 + 0.5) / 10) ELSE printf('%.2f MB', floor(size / 1048576.0 * 100 + 0.5) / 100) END"
    " || ' | ' || substr(sha256, 1, 16) || ' | ' || CASE WHEN bin THEN 'binary' WHEN size < 122880 THEN 'embedded' ELSE 'generated' END || ' |' AS \"value\" FROM f"
)
def inventory_markdown(spark, sf_dir):
    return inventory.markdown(inventory.inventory(_files(spark, sf_dir)))


@query(
    "SELECT p.page_id, count(*) FILTER (true)::BIGINT total_scanned FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(a|input|button|select|textarea|img)[ >]')) FROM pages) p GROUP BY p.page_id"
)
def scan_totals(spark, sf_dir):
    """Elements alone, as the pages' static nodes and words are none here."""
    e = pages.elements(table(spark, sf_dir, "pages"))
    none = spark.createDataFrame([], "page_id long, node_idx int"), spark.createDataFrame([], "frame_id long, token_no long")
    return detect.totals(e, *none).select("page_id", "total_scanned")
