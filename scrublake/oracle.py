"""SQL text for DuckDB, built from the same fixed patterns as the operators."""

from __future__ import annotations

import re

from scrublake.functions.text import NUM_END, NUM_START, WS, B
from scrublake.operators import rules as R


def pattern(p: str) -> str:
    """A pattern of ours as a quoted one for RE2: no lookaround, code points in its own spelling."""
    p = p.replace(B, r"\b").replace(NUM_START, "").replace(NUM_END, "")
    p = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", p).replace("\\x0B", "\\x{0B}")
    return "'" + p.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {pattern(WS + '+')}, ' ', 'g'))"


def around(text: str, start: str, end: str) -> str:
    a = f"greatest({start} - 48, 0)"
    return collapse(f"substr({text}, ({a} + 1)::BIGINT, (least(length({text}), {end} + 48) - {a})::BIGINT)")


def luhn(v: str) -> str:
    d = f"regexp_replace({v}, '[^0-9]', '', 'g')"
    digit = f"(ascii(substr({d}, length({d}) - i + 1, 1)) - 48)"
    return (
        f"(length({d}) BETWEEN 13 AND 19 AND coalesce(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} "
        f"WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END)), 0) % 10 = 0)"
    )


def _found(rule: R.Rule, no: int) -> str:
    """Matches of a rule, with places: gaps and matches summed up; a number's match takes the character before along, if any."""
    led = rule.pattern.startswith(NUM_START)
    p = pattern(rule.pattern)
    p = f"'(?:^|[^A-Za-z0-9])(' || {p} || ')'" if led else f"'(' || {p} || ')'"
    return f"""
m{no} AS (SELECT k, text, unnest(range(1, len(v) + 1)) i, v, w, g FROM (SELECT k, text, regexp_extract_all(text, {p}, 0) w, regexp_extract_all(text, {p}, 1) v,
  string_split_regex(text, {p}) g FROM src)),
c{no} AS (SELECT k, {no} r, i, v[i] val, (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0)
  + length(w[i]) - length(v[i]))::BIGINT s, text FROM m{no})"""


def _check(rule: R.Rule) -> str:
    context = around("text", "s", "s + length(val)")
    digits = "length(regexp_replace(val, '[^0-9]', '', 'g'))"
    return {
        None: "true",
        "domain": f"contains(string_split(val, '@')[2], '.') AND NOT regexp_matches(string_split(val, '@')[2], {pattern(R.ASSET)})",
        "luhn": luhn("val"),
        "id": f"NOT regexp_matches({context}, {pattern(R.NON_ID_CONTEXT)})",
        "phone": f"CASE WHEN regexp_matches(val, {pattern('[-.()+]|' + WS)}) THEN {digits} BETWEEN 10 AND 15 ELSE {digits} = 10 END",
        "account": f"regexp_matches({context}, {pattern(R.ACCOUNT_CONTEXT)}) AND NOT {luhn('val')}",
    }[rule.check]


def scan(source: str, where: str = "true") -> str:
    """The strict scan of ``source`` (k, text): a fold, written as a reduction of single candidates."""
    parts, union = [], []
    for no, rule in enumerate(R.STRICT):
        parts.append(_found(rule, no))
        confidence = f"{rule.confidence}"
        if rule.raised:
            confidence = f"CASE WHEN regexp_matches({around('text', 's', 's + length(val)')}, {pattern(R.ID_CONTEXT)}) THEN {rule.raised} ELSE {rule.confidence} END"
        union.append(f"SELECT k, r, i, {{'r': r, 't': '{rule.type}', 'v': val, 's': s, 'e': s + length(val), 'c': ({confidence})::DOUBLE}} d FROM c{no} WHERE {_check(rule)}")
    covered = ", ".join(str(i) for i, r in enumerate(R.STRICT) if r.covered)
    unseen = ", ".join(str(i) for i, r in enumerate(R.STRICT) if r.unseen)
    return f"""
WITH src AS ({source}),{",".join(parts)},
every AS ({" UNION ALL ".join(union)}),
folded AS (SELECT k, list_reduce(list_prepend([]::STRUCT(r INTEGER, t VARCHAR, v VARCHAR, s BIGINT, e BIGINT, c DOUBLE)[], list([d] ORDER BY r, i)),
  lambda acc, x: CASE WHEN (x[1].r IN ({covered}) AND len(list_filter(acc, lambda a: x[1].s >= a.s AND x[1].e <= a.e)) > 0)
    OR (x[1].r IN ({unseen}) AND len(list_filter(acc, lambda a: a.v = x[1].v)) > 0) THEN acc ELSE list_concat(acc, x) END) f FROM every GROUP BY k),
rows AS (SELECT k, unnest(range(0, len(f)))::INTEGER n, f FROM folded),
det AS (SELECT k doc_id, n det_no, f[n + 1].t "type", f[n + 1].v "value", f[n + 1].s::INTEGER "start", f[n + 1].e::INTEGER "end", floor(f[n + 1].c * 100 + 0.5) / 100 confidence,
  {around("text", "f[n + 1].s", "f[n + 1].e")} context FROM rows JOIN src USING (k) WHERE length({collapse("text")}) >= 3)
SELECT * FROM det WHERE {where}"""


def sanitized(source: str) -> str:
    """Common tables src, a, b, c, s: steps of the sanitiser over ``source`` (k, text)."""
    from scrublake.operators import sanitize as Z

    def step(name: str, before: str, p: str, label: str, start: str, spared: str = "") -> str:
        keep = f"lambda v: v NOT IN ({spared})" if spared else "lambda v: true"
        number = f"({start} + len(list_filter(m[1:i], {keep})))"
        put = f"'[REDACTED_{label}_' || {number} || ']'"
        if spared:
            put = f"CASE WHEN m[i] IN ({spared}) THEN m[i] ELSE {put} END"
        return (
            f"{name} AS (SELECT * EXCLUDE (t, m, g), g[1] || array_to_string(list_transform(range(1, len(m) + 1), lambda i: {put} || g[i + 1]), '') t, list_filter(m, {keep}) f_{name} "
            f"FROM (SELECT *, regexp_extract_all(t, {pattern(p)}, 0) m, string_split_regex(t, {pattern(p)}) g FROM {before}))"
        )

    secret = pattern(Z.SECRET)
    local = ", ".join(f"'{x}'" for x in Z.LOCAL)
    return f"""src AS ({source}), z AS (SELECT *, coalesce(text, '') t FROM src),
{step("a", "z", Z.EMAIL, "EMAIL", "0")},
{step("b", "a", Z.PHONE, "PHONE", "len(f_a)")},
c AS (SELECT * EXCLUDE (t), regexp_replace(t, {secret}, '\\1[REDACTED_SECRET_KEY]\\3', 'g') t, regexp_extract_all(t, {secret}, 2) f_c FROM b),
{step("d", "c", Z.IP, "IP", "len(f_a) + len(f_b) + len(f_c)", local)},
s AS (SELECT *, list_concat(list_concat(list_concat(list_transform(f_a, lambda v: 'Email (' || string_split(v, '@')[2] || ')'), list_transform(f_b, lambda v: 'Phone Number')),
  list_transform(f_c, lambda v: 'Secret / API Key')), list_transform(f_d, lambda v: 'IP Address')) every, len(f_a) + len(f_b) + len(f_c) + len(f_d) masked FROM d)"""
