"""Golden cases, invariants, and an independent model of the rules in Python."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scrublake.fixtures import FIELDS, LOOSE_TEXTS, TEXTS
from scrublake.functions.text import collapse, fingerprint, half_up, luhn, matches, trim
from scrublake.operators import rules as R
from scrublake.operators.fields import MASK, field_detections
from scrublake.operators.scan import may_match, scan_text

GOLDEN = [
    ("+91 98765 43210", [("PHONE", 0, 15, 0.88)]), ("98765 43210", [("PHONE", 0, 11, 0.88)]), ("080-2345-6789", [("PHONE", 0, 13, 0.88)]), ("011 2345 6789", [("PHONE", 0, 13, 0.88)]),
    ("9876543210", [("PHONE", 0, 10, 0.9)]), ("+1 (323) 555-9830", [("PHONE", 0, 17, 0.9)]), ("Track 987654321098", []), ("code 987654321098", [("NATIONAL_ID", 5, 17, 0.62)]),
    ("Aadhaar 9876 5432 1098", [("NATIONAL_ID", 8, 22, 0.94)]), ("SSN 123-45-6789", [("NATIONAL_ID", 4, 15, 0.95)]), ("4111 1111 1111 1111", [("CREDIT_CARD", 0, 19, 0.95)]),
    ("4111111111111111", [("CREDIT_CARD", 0, 16, 0.96)]), ("4111111111111112", []), ("account no 123456789012345", [("ACCOUNT_NUM", 11, 26, 0.85)]), ("bank a/c 123456789", [("ACCOUNT_NUM", 9, 18, 0.85)]),
    ("order 123456789", []), ("job acceleration 123456789", [("ACCOUNT_NUM", 17, 26, 0.85)]), ("reach me at a.b@x.org now", [("EMAIL", 12, 21, 0.97)]), ("icon@2x.png here", []), ("user@localhost", []),
    ("é123-45-6789", [("NATIONAL_ID", 1, 12, 0.95)]), ("  ", []), (None, []), ("a@b.co " * 2, [("EMAIL", 0, 6, 0.97), ("EMAIL", 7, 13, 0.97)]),
]
LOOSE = [
    ("l23-45-6789", [("NATIONAL_ID", 0, 11, 0.72)]), ("O876 5432 1098", [("NATIONAL_ID", 0, 14, 0.7)]), ("4lll 1111 1111 1111", [("NATIONAL_ID", 0, 14, 0.7)]), ("98765 432lO", []), ("Track 987654321098", []),
]


def scanned(spark, texts, lenient=False):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in scan_text(d, base=F.lit("t"), lenient=lenient).orderBy("i", "det_no").collect():
        out[r.i].append(r)
    return out


@pytest.mark.parametrize("cases,lenient", [(GOLDEN, False), (LOOSE, True)])
def test_golden(spark, cases, lenient):
    got = scanned(spark, [t for t, _ in cases], lenient)
    for i, (t, expected) in enumerate(cases):
        assert [(r.type, r.start, r.end, r.confidence) for r in got[i]] == expected, t
        for n, r in enumerate(got[i]):
            assert t[r.start : r.end] == r.value and r.id == f"t-{r.type.lower()}-{n}"


WS = "\t\n\x0b\f\r \xa0                　﻿"


def model(text):
    """The strict rules again, with Python's expressions."""

    def luhn_ok(v):
        d = [int(c) for c in v if c in "0123456789"]
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    py = lambda p: re.compile(p.replace("\\x0B", "\\x0b"), re.ASCII)
    around = lambda s, e: re.sub(f"[{WS}]+", " ", text[max(0, s - 48) : e + 48]).strip(" ")
    out = []
    if len(text.strip(WS)) < 3:
        return out
    for rule in R.STRICT:
        for m in py(rule.pattern).finditer(text):
            v, s, e = m[0], m.start(), m.end()
            digits = re.sub("[^0-9]", "", v)
            c = rule.confidence
            if rule.check == "domain" and ("." not in v.split("@")[1] or re.search(R.ASSET, v.split("@")[1])):
                continue
            if rule.check == "luhn" and not luhn_ok(v):
                continue
            if rule.check == "id" and re.search(R.NON_ID_CONTEXT, around(s, e)):
                continue
            if rule.check == "phone" and not (10 <= len(digits) <= 15 if re.search(f"[-.()+{WS}]", v) else len(digits) == 10):
                continue
            if rule.check == "account" and (luhn_ok(v) or not re.search(R.ACCOUNT_CONTEXT, around(s, e)) or v in [o[1] for o in out]):
                continue
            if rule.covered and any(s >= o[2] and e <= o[3] for o in out):
                continue
            if rule.raised and re.search(R.ID_CONTEXT, around(s, e)):
                c = rule.raised
            out.append((rule.type, v, s, e, c))
    return out


def test_against_model(spark):
    pieces = st.sampled_from([*TEXTS, "é", " ", "account ", "order\t", "\xa0", "4", "-", "id no ", "98765", "@", ".com", "(212) ", "555-0199"])
    texts = []

    @settings(max_examples=150, deadline=None, derandomize=True, database=None)
    @given(st.lists(pieces, min_size=1, max_size=7))
    def collect(parts):
        texts.append("".join(parts))

    collect()
    got = scanned(spark, texts)
    for i, t in enumerate(texts):
        assert [(r.type, r.value, r.start, r.end, r.confidence) for r in got[i]] == model(t), t


def test_prefilter_loses_nothing(spark):
    d = spark.createDataFrame([(t,) for t in TEXTS + LOOSE_TEXTS], "text string")
    assert d.where(may_match(F.col("text"), lenient=True)).count() >= d.join(scan_text(d.withColumn("k", F.col("text")), lenient=True).select("k").distinct(), F.col("text") == F.col("k")).count()


def test_text_functions(spark):
    r = spark.range(1).select(
        trim(F.lit("\xa0\t a b 　")).alias("t"), collapse(F.lit(" a\n\xa0 b ")).alias("c"), fingerprint(F.lit("O1l-zSb Gau!")).alias("f"), half_up(F.lit(-2.5)).alias("h"),
        half_up(F.lit(0.125), 2).alias("p"), luhn(F.lit("4111-1111 1111 1111")).alias("y"), luhn(F.lit("4111")).alias("n"), matches(F.lit("ab12c345"), "[0-9]+").alias("m"), matches(F.lit(""), "x").alias("e"),
    ).first()
    assert (r.t, r.c, r.f, r.h, r.p, r.y, r.n, r.e) == ("a b", "a b", "111258940", -2.0, 0.13, True, False, [])
    assert [(x.value, x.start, x.end) for x in r.m] == [("12", 2, 4), ("345", 5, 8)]


def test_fields(spark):
    e = spark.createDataFrame(list(FIELDS), "el_idx int, id string, type string, label_text string, attributes map<string,string>")
    got = [(r.el_idx, r.kind, r.value, r.confidence, r.context) for r in field_detections(e).orderBy("el_idx", "det_no").collect()]
    assert got == [
        (1, "PASSWORD", "[Password Input: enter password]", 0.99, "enter password"), (2, "CREDIT_CARD", "4111 1111 1111 1111", 0.95, "Card number"), (3, "NATIONAL_ID", "[National ID Field: a1234567]", 0.92, "Passport"),
        (4, "ACCOUNT_NUM", "DE89 3704 0044 0532 0130 00", 0.9, "iban"), (5, "ADDRESS", "[Address Field: street]", 0.88, "street"), (6, "NAME", "Ann Lee", 0.86, "Full-name"),
    ]
    p = spark.createDataFrame([(0, "p", None, None, {"type": "password", "value": "x"}), (1, None, None, None, None)], e.schema)
    assert [r.value for r in field_detections(p).collect()] == [MASK]
