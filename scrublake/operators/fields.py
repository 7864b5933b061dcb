"""Form fields: what a field's attributes and label say that it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrublake.functions.text import or_else, trim

# Words that name a kind of field.
WORDS = {
    "PASSWORD": r"(?i)(?:password|passwd|passcode|pin|secret|cvv|cvc|security[_-]?code)",
    "CREDIT_CARD": r"(?i)(?:credit[_-]?card|debit[_-]?card|card[_-]?number|cc[_-]?number|card[_-]?num|cc[_-]?num|exp[_-]?date|cvv|cvc)",
    "NATIONAL_ID": r"(?i)(?:aadhaar|ssn|social[_-]?security|passport|national[_-]?id|tax[_-]?id|pan[_-]?card|voter[_-]?id)",
    "ACCOUNT_NUM": r"(?i)(?:account[_-]?num|acct[_-]?num|account[_-]?number|bank[_-]?acc|routing[_-]?num|iban|swift)",
    "ADDRESS": r"(?i)(?:street[_-]?address|billing[_-]?address|shipping[_-]?address|postal[_-]?code|zip[_-]?code|residential[_-]?address)",
    "NAME": r"(?i)(?:full[_-]?name|first[_-]?name|last[_-]?name|customer[_-]?name|cardholder[_-]?name)",
}
FILLS = {
    "CREDIT_CARD": ("Credit Card Field", 0.95, ("cc-number", "cc-exp", "cc-csc")),
    "NATIONAL_ID": ("National ID Field", 0.92, ()),
    "ACCOUNT_NUM": ("Bank Account Field", 0.90, ()),
    "ADDRESS": ("Address Field", 0.88, ("address", "postal-code", "zip")),
}
MASK = "••••••••"


def fields_in() -> tuple[Column, Column]:
    """Of an element row (id, type, label_text, attributes): an array of what its field holds (kind, value, confidence), and the context.

    A password field gives one detection only, with its value masked. Null attributes count as missing.
    """
    attr = lambda k: F.coalesce(F.col("attributes").getItem(k), F.lit(""))
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    kind = F.lower(or_else(F.col("attributes").getItem("type"), F.col("type")))
    auto, name, ident, hint = F.lower(attr("autocomplete")), F.lower(attr("name")), low(F.col("id")), F.lower(attr("placeholder"))
    aria = F.lower(or_else(F.col("attributes").getItem("aria-label"), F.col("attributes").getItem("aria-labelledby")))
    value = trim(attr("value"))
    label = F.coalesce("label_text", F.lit(""))
    said = F.concat_ws(" ", name, ident, hint, aria, attr("class"), label)
    context = F.substring(or_else(label, hint, name), 1, 80)

    def made(what: str, text: Column, confidence: float) -> Column:
        return F.struct(F.lit(what).alias("kind"), text.alias("value"), F.lit(confidence).alias("confidence"))

    def has(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(auto, F.lit(w))
        return out

    password = (kind == "password") | has(("password",)) | said.rlike(WORDS["PASSWORD"])
    masked = F.when(value != "", F.lit(MASK)).otherwise(F.concat(F.lit("[Password Input: "), F.coalesce(F.nullif(or_else(hint, name, ident), F.lit("")), F.lit("masked")), F.lit("]")))
    others = []
    for what, (title, confidence, autos) in FILLS.items():
        text = F.when(value != "", value).otherwise(F.concat(F.lit(f"[{title}: "), or_else(hint, name), F.lit("]")))
        others.append(F.when((has(autos) | said.rlike(WORDS[what])) & ((value != "") | (hint != "")), made(what, text, confidence)))
    named = auto.isin("name", "given-name", "family-name") | said.rlike(WORDS["NAME"])
    others.append(F.when(named & (F.length(value) > 2), made("NAME", value, 0.86)))
    found = F.when(password, F.array(made("PASSWORD", masked, 0.99))).otherwise(F.array_compact(F.array(*others)))
    return found, context


def field_detections(element: DataFrame) -> DataFrame:
    """Detections from element rows (el_idx, id, type, label_text, attributes, ...): their columns, then det_no, kind, value, confidence,
    context."""
    found, context = fields_in()
    rows = element.select("*", context.alias("context"), F.posexplode(found).alias("det_no", "_d"))
    return rows.select(*element.columns, "det_no", "_d.kind", "_d.value", "_d.confidence", "context")


def text_pool() -> Column:
    """What an element says, joined for the text scan."""
    parts = [F.col("text"), *(F.col("attributes").getItem(k) for k in ("value", "placeholder", "aria-label")), F.col("label_text")]
    return F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts))
