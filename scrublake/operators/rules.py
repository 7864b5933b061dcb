"""The detection rules as data. Order matters: earlier rules shadow later ones."""

from __future__ import annotations

from dataclasses import dataclass

from scrublake.functions.text import NUM_END, NUM_START, WS, B

# Patterns, context words and confidences of the rules.
COUNTRY = rf"(?:\+[0-9]{{1,3}}(?:[-.]|{WS})?|[0-9]{{1,3}}[-.]{WS}?)"
SEP = rf"(?:[-.]|{WS})"
LOOSE = "[0-9OoIlZSGB]"
EMAIL = rf"{B}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{B}"
SSN = rf"{B}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{B}"
CARD = rf"{B}(?:4[0-9]{{12}}(?:[0-9]{{3}})?|5[1-5][0-9]{{14}}|3[47][0-9]{{13}}|6(?:011|5[0-9]{{2}})[0-9]{{12}}){B}"
CARD_GROUPED = rf"{B}(?:[0-9][ -]?){{12,18}}[0-9]{B}"
ID12 = rf"{B}[2-9][0-9]{{3}}{WS}?[0-9]{{4}}{WS}?[0-9]{{4}}{B}"
PHONE = rf"{NUM_START}(?:{COUNTRY}{SEP}?)?\(?[0-9]{{3}}\)?{SEP}?[0-9]{{3}}{SEP}?[0-9]{{4}}{B}"
PHONE_344 = rf"{NUM_START}(?:{COUNTRY})?[0-9]{{3}}{SEP}[0-9]{{4}}{SEP}[0-9]{{4}}{B}"
PHONE_55 = rf"{NUM_START}(?:{COUNTRY})?[0-9]{{5}}{SEP}[0-9]{{5}}{B}"
ACCOUNT = rf"{B}[0-9]{{9,18}}{B}"
LOOSE_CARD = rf"{NUM_START}(?:{LOOSE}(?:-|{WS})?){{12,18}}{LOOSE}{NUM_END}"
LOOSE_ID = rf"{NUM_START}[2-9OoIl]{LOOSE}{{3}}(?:-|{WS})?{LOOSE}{{4}}(?:-|{WS})?{LOOSE}{{4}}{NUM_END}"
LOOSE_PHONE = (
    rf"{NUM_START}(?:\+{LOOSE}{{1,3}}{SEP}?|{LOOSE}{{1,3}}[.]{WS})?"
    rf"(?:{LOOSE}{{3}}{SEP}?{LOOSE}{{3}}{SEP}?{LOOSE}{{4}}|{LOOSE}{{5}}{SEP}?{LOOSE}{{5}}|{LOOSE}{{3}}{SEP}{LOOSE}{{4}}{SEP}{LOOSE}{{4}}){NUM_END}"
)
LOOSE_SSN = rf"{NUM_START}{LOOSE}{{3}}(?:-|{WS}){LOOSE}{{2}}(?:-|{WS}){LOOSE}{{4}}{NUM_END}"
ASSET = r"(?i)\.(png|jpg|jpeg|gif|webp|svg|css|js|html?)$"
ACCOUNT_CONTEXT = rf"(?i)(?:account|acct|a/c|acc\.?|bank|routing|rtgs|neft|imps|iban|swift|ifsc|cheque|check{WS}*no)"
ID_CONTEXT = (
    rf"(?i)(?:aadhaar|aadhar|uidai|national{WS}*id|identity{WS}*(?:no|number|proof)|id{WS}*(?:no|number)|govt|government|voter|passport|pan{WS}*(?:card|no|number)"
    rf"|ssn|social{WS}*security|tax{WS}*id)"
)
NON_ID_CONTEXT = (
    rf"(?i)(?:order|tracking|track|invoice|receipt|bill{WS}*no|txn|transaction|utr|reference|ref{WS}*no|ticket|coupon|promo|batch|job|sku|imei|imn|order{WS}*id"
    rf"|tracking{WS}*id|trace|waybill|awb|rrn|rr{WS}*no)"
)


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    pattern: str
    confidence: float
    covered: bool = True  # not inside an accepted span
    check: str | None = None  # a validator in scan.py
    unseen: str | None = None  # "value": no accepted detection has this text; "look": nor one that looks like it
    raised: float | None = None  # confidence in the context of an identity document
    needs: str | None = None  # a quick pattern that every match holds


STRICT = (
    Rule("R1", "EMAIL", EMAIL, 0.97, covered=False, check="domain", needs="@"),
    Rule("R2", "NATIONAL_ID", SSN, 0.95, covered=False, needs="[0-9]-[0-9]{2}-[0-9]{4}"),
    Rule("R3", "CREDIT_CARD", CARD, 0.96, covered=False, check="luhn", needs="[0-9]{13}"),
    Rule("R4", "CREDIT_CARD", CARD_GROUPED, 0.95, check="luhn", needs="(?:[0-9][ -]?){12}[0-9]"),
    Rule("R5", "NATIONAL_ID", ID12, 0.62, check="id", raised=0.94, needs=rf"[0-9]{{4}}{WS}?[0-9]{{4}}{WS}?[0-9]{{4}}"),
    Rule("R6", "PHONE", PHONE, 0.90, check="phone", needs=rf"[0-9]{{3}}\)?{SEP}?[0-9]{{3}}{SEP}?[0-9]{{4}}"),
    Rule("R7a", "PHONE", PHONE_344, 0.88, needs=rf"[0-9]{{3}}{SEP}[0-9]{{4}}{SEP}[0-9]{{4}}"),
    Rule("R7b", "PHONE", PHONE_55, 0.88, needs=rf"[0-9]{{5}}{SEP}[0-9]{{5}}"),
    Rule("R8", "ACCOUNT_NUM", ACCOUNT, 0.85, check="account", unseen="value", needs="[0-9]{9}"),
)
LENIENT = (
    Rule("R9", "CREDIT_CARD", LOOSE_CARD, 0.72, check="luhn", unseen="look"),
    Rule("R10", "NATIONAL_ID", LOOSE_ID, 0.70, check="id", unseen="look", raised=0.85),
    Rule("R11", "PHONE", LOOSE_PHONE, 0.68, check="loose_phone", unseen="look"),
    Rule("R12", "NATIONAL_ID", LOOSE_SSN, 0.72, check="id", unseen="look", raised=0.85),
)
