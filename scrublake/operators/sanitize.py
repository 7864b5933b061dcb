"""Sanitising, summarising and auditing of texts, and routing of prompts to these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.text import WS, B, or_else

# What is redacted, addresses that are not, tracking parameters, words that route a prompt.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = rf"(?:\+?[0-9]{{1,3}}(?:[-.]|{WS})?)?\(?[0-9]{{3}}\)?(?:[-.]|{WS})?[0-9]{{3}}(?:[-.]|{WS})?[0-9]{{4}}"
SECRET = rf"(?i)((?:api[_-]?key|secret|token|bearer|auth)['\"]?{WS}*[:=]{WS}*['\"]?)([a-zA-Z0-9_\-]{{16,}})(['\"]?)"
IP = rf"{B}(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}{B}"
LOCAL = ("127.0.0.1", "0.0.0.0")
TRACKER = r"(?i)[?&](utm_|fbclid|gclid|trk)"
SUMMARY_WORDS = ("summar", "brief", "overview")
AUDIT_WORDS = ("audit", "secur", "privacy", "check")


# What every match of a step holds; looked for first, as most texts hold none.
CHEAP = {"EMAIL": "@", "PHONE": "[0-9]{3}", "SECRET": "(?i)key|secret|token|bearer|auth", "IP": r"[0-9]\.[0-9]"}


def _found(df: DataFrame, name: str, label: str, pattern: str, group: int = 0) -> DataFrame:
    """The matches in _t as a column of their own, so that they are looked for once."""
    none = F.array().cast("array<string>")
    return df.withColumn(name, F.when(F.col("_t").rlike(CHEAP[label]), F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))).otherwise(none))


def _numbered(df: DataFrame, name: str, label: str, pattern: str, before: Column, spared: tuple[str, ...] = ()) -> DataFrame:
    """Matches become numbered labels, counting on from ``before``; ``name`` has the matches that did."""
    df = _found(df, name, label, pattern)
    keep = lambda v: ~v.isin(list(spared)) if spared else F.lit(True)
    number = lambda i: before + F.size(F.filter(F.slice(F.col(name), F.lit(1), i + 1), keep))
    put = F.transform(name, lambda v, i: F.when(keep(v), F.concat(F.lit(f"[REDACTED_{label}_"), number(i).cast("string"), F.lit("]"))).otherwise(v))
    gaps = F.split("_t", pattern, -1)
    out = F.array_join(F.flatten(F.zip_with(gaps, put, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    df = df.withColumn("_t", F.when(F.size(name) > 0, out).otherwise(F.col("_t")))
    return df.withColumn(name, F.filter(name, keep)) if spared else df


def sanitize(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with sanitized, masked_count and entities (each once, in order of finding) of the text; all_entities keeps repeats.

    E-mail, phone, secret, then IP address: each step works on the text that the one before left, with one running number. A null text is
    an empty one.
    """
    names = ["_0", "_1", "_2", "_3"]
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = _numbered(df, "_0", "EMAIL", EMAIL, F.lit(0))
    df = _numbered(df, "_1", "PHONE", PHONE, F.size("_0"))
    df = _found(df, "_2", "SECRET", SECRET, 2)
    df = df.withColumn("_t", F.when(F.size("_2") > 0, F.regexp_replace("_t", SECRET, "$1[REDACTED_SECRET_KEY]$3")).otherwise(F.col("_t")))
    df = _numbered(df, "_3", "IP", IP, F.size("_0") + F.size("_1") + F.size("_2"), LOCAL)
    every = F.concat(
        F.transform("_0", lambda v: F.concat(F.lit("Email ("), F.element_at(F.split(v, "@"), 2), F.lit(")"))), F.transform("_1", lambda v: F.lit("Phone Number")),
        F.transform("_2", lambda v: F.lit("Secret / API Key")), F.transform("_3", lambda v: F.lit("IP Address")),
    )
    return df.withColumns({"sanitized": F.col("_t"), "all_entities": every, "entities": F.array_distinct(every), "masked_count": sum(F.size(n) for n in names)}).drop("_t", *names)


def summary(title: Column) -> Column:
    """The local summary of a sanitised row."""
    start = F.substring("sanitized", 1, 300)
    return F.concat(
        F.lit('Safe Local Summary for "'), or_else(title, F.lit("Current Webpage")), F.lit('":\n• Privacy Shield Status: Verified (All PII filtered)\n• Core Content: '),
        F.when(start != "", F.concat(start, F.lit("..."))).otherwise("Clean context extracted."), F.lit("\n• Detected entities removed: "),
        F.when(F.size("all_entities") > 0, F.array_join("all_entities", ", ")).otherwise("None"),
    )


def is_https(url: Column) -> Column:
    return F.startswith(F.coalesce(url, F.lit("")), F.lit("https://"))


def is_web(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    return F.startswith(u, F.lit("http://")) | F.startswith(u, F.lit("https://"))


def has_tracker(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike(TRACKER)


def audit(url: Column) -> Column:
    """The security audit of a sanitised row."""
    return F.concat(
        F.lit("Security Audit for: "), F.coalesce(url, F.lit("")), F.lit("\n• Protocol: "), F.when(is_https(url), "🔒 Secure HTTPS").otherwise("⚠️ Unencrypted HTTP"),
        F.lit("\n• URL Tracking Parameters: "), F.when(has_tracker(url), "Detected & Stripped").otherwise("None detected"), F.lit("\n• PII Exposure Risk: "),
        F.when(F.size("all_entities") > 0, F.concat(F.lit("High (Masked "), F.col("masked_count").cast("string"), F.lit(" tokens)"))).otherwise("Low (Safe)"),
    )


#: Fixed value: how sure a response says that it is.
CONFIDENCE = 0.99


def respond(requests: DataFrame) -> DataFrame:
    """The columns of ``requests`` (action, text, title, url and any others) but the text, then what a request gets: success, result, masked_count,
    detected_entities (each once), confidence_score.

    The result is a summary, a security audit, or else the sanitised text, by action. Null texts are empty.
    """
    own = [c for c in requests.columns if c != "text"]
    s = sanitize(requests)
    result = F.when(F.col("action") == "SUMMARIZE_LOCAL", summary(F.col("title"))).when(F.col("action") == "ANALYZE_SECURITY", audit(F.col("url"))).otherwise(F.col("sanitized"))
    return s.select(*own, F.lit(True).alias("success"), result.alias("result"), "masked_count", F.col("entities").alias("detected_entities"), F.lit(CONFIDENCE).alias("confidence_score"))


def route(prompt: Column) -> Column:
    """What a prompt asks for."""
    low = F.lower(F.coalesce(prompt, F.lit("")))

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(low, F.lit(w))
        return out

    return F.when(has(SUMMARY_WORDS), "SUMMARIZE_LOCAL").when(has(AUDIT_WORDS), "ANALYZE_SECURITY").otherwise("SANITIZE_PII")


def request_text(prompt: Column, snippet: Column, title: Column) -> Column:
    return F.concat(F.coalesce(prompt, F.lit("")), F.lit("\n\nContext:\n"), or_else(snippet, title))


def active_tab(tabs: DataFrame, session: str = "session_id") -> DataFrame:
    """Of each session (all windows of a browser), the active tab of the focused window, whatever it shows; else the first active tab with a
    web address, else the first active one. A session without active tabs gets a row that says so, null but for title and url.

    ``tabs`` has tab_no, active, focused (whether its window is), title and url.
    """
    rank = F.when(F.col("focused"), 0).when(is_web(F.col("url")), 1).otherwise(2)
    named = {"title": "No active tab", "url": "about:blank"}
    row = F.struct(*[c for c in tabs.columns if c != session])
    chosen = tabs.groupBy(session).agg(F.min_by(row, F.when(F.col("active"), F.struct(rank, "tab_no"))).alias("_t"))
    none = F.col("_t").isNull()
    return chosen.select(session, *(F.when(none, F.lit(named.get(c))).otherwise(F.col("_t")[c]).alias(c) for c in tabs.columns if c != session))
