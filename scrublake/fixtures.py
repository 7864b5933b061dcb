"""Small inputs, as SQL text that both engines read, for rules that the tables don't exercise."""

from __future__ import annotations

TEXTS = (
    "+91 98765 43210", "98765 43210", "080-2345-6789", "011 2345 6789", "9876543210", "+1 (323) 555-9830", "Track 987654321098", "code 987654321098", "Aadhaar 9876 5432 1098",
    "SSN 123-45-6789", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "account no 123456789012345", "bank a/c 123456789", "order 123456789", "job acceleration 123456789",
    "reach me at a.b@x.org now", "icon@2x.png here", "user@localhost", "call 212-555-1234 or 212 555 1234, mail a@b.co; c@d.io", "card 4111-1111-1111-1111 and iban 1234567890123",
)
LOOSE_TEXTS = ("l23-45-6789", "O876 5432 1098", "4lll 1111 1111 1111", "98765 432lO", "Track 987654321098", "4111 1111 1111 1111 x")


def texts_sql(texts: tuple[str, ...]) -> str:
    """Rows of a number below zero and a text."""
    return "SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, '{t}')" for i, t in enumerate(texts)) + ") AS f(doc_id, text)"


#: page_id, det_no, id, type, text, left, top, width, height, source, confidence
DETECTIONS = (
    (1, 0, "d0", "EMAIL", "john.doe@company.org", 50, 60, 280, 38, "DOM", 0.97), (1, 1, "o0", "EMAIL", "john.doe@company.org", 55, 65, 130, 20, "OCR", 0.95),
    (1, 2, "d1", "PASSWORD", "••••••••", 50, 110, 280, 38, "DOM", 0.99), (1, 3, "o1", "PHONE", "98765 43210", 400, 10, 90, 16, "OCR", 0.88),
    (2, 0, "o2", "CREDIT_CARD", "4111 1111 1111 1111", 10, 10, 200, 20, "OCR", 0.72), (2, 1, "d2", "CREDIT_CARD", "4111111111111111", 12, 10, 190, 20, "DOM", 0.96),
    (2, 2, "o3", "CREDIT_CARD", "4lll 1111 1111 1111", 10, 300, 200, 20, "OCR", 0.72), (2, 3, "d3", "NAME", "Ann Lee", 10, 60, 100, 20, "DOM", 0.86),
)
DETECTIONS_SQL = "SELECT * FROM (VALUES " + ", ".join(str(d) for d in DETECTIONS) + ") AS f(page_id, det_no, id, type, text, l, t, w, h, source, confidence)"

#: el_idx, id, type, label_text, attributes
FIELDS = (
    (0, "input-email", "email", None, {"placeholder": "test.user@example.com", "value": "john.doe@company.org"}), (1, "input-pwd", "password", None, {"placeholder": "Enter password", "type": "password"}),
    (2, "cc", "text", "Card number", {"autocomplete": "cc-number", "value": "4111 1111 1111 1111"}), (3, "f3", "text", "Passport", {"name": "passport_no", "placeholder": "A1234567"}),
    (4, "f4", "text", None, {"name": "iban", "value": "DE89 3704 0044 0532 0130 00"}), (5, "f5", "text", None, {"autocomplete": "street-address", "placeholder": "Street"}),
    (6, "f6", "text", "Full-name", {"autocomplete": "name", "value": "Ann Lee"}), (7, "f7", "text", None, {"autocomplete": "name", "value": "Al"}), (8, "f8", "text", "Search", {}),
)
