"""Text scan: candidates of all rules, in their order, folded into detections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.text import WS, around, digits, fingerprint, half_up, luhn, matches, trim

from . import rules as R

_FOUND = "array<struct<type:string,value:string,start:int,end:int,confidence:double,rule:string>>"


def _valid(rule: R.Rule, text: Column, m: Column) -> Column:
    """Whether a match passes the rule's own check."""
    v = m["value"]
    context = around(text, m["start"], m["end"])
    d = F.length(digits(v))
    if rule.check == "domain":
        domain = F.element_at(F.split(v, "@"), 2)
        return F.contains(domain, F.lit(".")) & ~domain.rlike(R.ASSET)
    if rule.check == "luhn":
        return luhn(v)
    if rule.check == "id":
        return ~context.rlike(R.NON_ID_CONTEXT)
    if rule.check == "phone":
        return F.when(v.rlike(rf"[-.()+]|{WS}"), d.between(10, 15)).otherwise(d == 10)
    if rule.check == "loose_phone":
        return d.between(10, 15) & (v.rlike(rf"[.+-]|{WS}") | (d == 10))
    if rule.check == "account":
        return context.rlike(R.ACCOUNT_CONTEXT) & ~luhn(v)
    return F.lit(True)


def _candidates(rule: R.Rule, text: Column) -> Column:
    found = matches(text, rule.pattern)
    if rule.needs:
        found = F.when(text.rlike(rule.needs), found).otherwise(F.array().cast("array<struct<value:string,start:int,end:int>>"))
    if rule.check:
        found = F.filter(found, lambda m: _valid(rule, text, m))

    def made(m: Column) -> Column:
        confidence = F.lit(rule.confidence)
        if rule.raised:
            confidence = F.when(around(text, m["start"], m["end"]).rlike(R.ID_CONTEXT), rule.raised).otherwise(rule.confidence)
        return F.struct(
            F.lit(rule.type).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end"), confidence.alias("confidence"), F.lit(rule.name).alias("rule")
        )

    return F.transform(found, made)


def _shadowed(accepted: Column, c: Column, rules: tuple[R.Rule, ...]) -> Column:
    """Whether what was accepted before rules a candidate out."""
    names = lambda pick: [r.name for r in rules if pick(r)]
    out = c["rule"].isin(names(lambda r: r.covered)) & F.exists(accepted, lambda a: (c["start"] >= a["start"]) & (c["end"] <= a["end"]))
    out = out | (c["rule"].isin(names(lambda r: r.unseen)) & F.exists(accepted, lambda a: a["value"] == c["value"]))
    look = names(lambda r: r.unseen == "look")
    if look:
        out = out | (c["rule"].isin(look) & F.exists(accepted, lambda a: fingerprint(a["value"]) == fingerprint(c["value"])))
    return out


def detections_in(text: Column, lenient: bool = False) -> Column:
    """Detections of a text as an array, in the order of the rules, then of the text."""
    rules = R.STRICT + (R.LENIENT if lenient else ())
    every = reduce(F.concat, (_candidates(r, text) for r in rules))
    folded = F.aggregate(
        every.cast(_FOUND), F.array().cast(_FOUND), lambda acc, c: F.when(_shadowed(acc, c, rules), acc).otherwise(F.concat(acc, F.array(c)))
    )
    return F.when(F.length(trim(text)) >= 3, folded)


def may_match(text: Column, lenient: bool = False) -> Column:
    """A condition that every text with a detection fulfils: cheap, and looked at before the rules.

    Whatever isn't an address ends in seven digits, or letters that look like such, with a separator at most after each.
    """
    run = rf"(?:{R.LOOSE}{R.SEP}?){{7}}" if lenient else r"(?:[0-9][ -]?){3}"
    return F.contains(text, F.lit("@")) | text.rlike(run)


def scan_text(df: DataFrame, text: str = "text", base: Column | None = None, lenient: bool = False, scale: float = 1.0) -> DataFrame:
    """A row for each detection: the columns of ``df`` but the text, then det_no (from 0), id, type, value, start, end, confidence, context.

    ``base`` begins the ids. Offsets are in characters. Rows without detections, null and short texts give none.
    """
    t = F.col(text)
    own = [c for c in df.columns if c != text]
    found = df.where(may_match(t, lenient)).select(*own, t.alias("_text"), detections_in(t, lenient).alias("_found"))
    # outer, as the filter that Spark infers for a plain explode would run the rules twice more
    rows = found.select(*own, "_text", F.posexplode_outer("_found").alias("det_no", "_d")).where("det_no is not null")
    name = F.concat_ws("-", *([base] if base is not None else []), F.lower("_d.type"), F.col("det_no").cast("string"))
    return rows.select(
        *own, "det_no", name.alias("id"), F.col("_d.type").alias("type"), F.col("_d.value").alias("value"), F.col("_d.start").alias("start"), F.col("_d.end").alias("end"),
        half_up(F.col("_d.confidence") * scale, 2).alias("confidence"), around(F.col("_text"), F.col("_d.start"), F.col("_d.end")).alias("context"),
    )
