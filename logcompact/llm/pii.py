"""Personal data by anchors: an automaton finds marks and cues, local parsers find the bounds around them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logcompact.llm.common import text_or_empty

# The alphabets of the spans, and the words that announce identifiers.
DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
HOST = LABEL | frozenset(".")
SECRET = LETTERS | DIGITS | frozenset("_-")
CUES = {
    "account": ("account number", "account no", "iban"),
    "national_id": ("ssn", "social security number", "passport number"),
    "secret": ("api_key", "apikey", "secret_key", "token", "password"),
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("url_login", "account", "national_id", "secret")
KEY_MARK, KEY_LENGTH = "AKIA", 20
KEY = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ") | DIGITS
#: Characters of a value at least; letters and digits of an IBAN.
SHORTEST, IBAN = 6, (15, 34)
#: Cues are told in any case; folding must not move places.
FOLDED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

Span = tuple[int, int]


def folded(text: str) -> str:
    """The text in lower case with every character in its place; lower() is faster, but makes two of some characters."""
    lower = text.lower()
    return lower if len(lower) == len(text) else text.translate(FOLDED)


def run_right(text: str, at: int, among: frozenset[str]) -> int:
    """End of the characters of a set that begin at a place."""
    n = len(text)
    while at < n and text[at] in among:
        at += 1
    return at


def run_left(text: str, at: int, among: frozenset[str], floor: int) -> int:
    while at > floor and text[at - 1] in among:
        at -= 1
    return at


def email_at(text: str, at: int, floor: int) -> Span | None:
    """Around an at-sign: a local part from `floor` on, and a domain of two labels at least."""
    start = run_left(text, at, LOCAL, floor)
    end = run_right(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (label := run_right(text, end + 1, LABEL)) > end + 1:
        end, dots = label, dots + 1
    return (start, end) if dots else None


def ip_from(text: str, at: int) -> Span | None:
    """Four numbers with points between, from a digit on."""
    end = run_right(text, at, DIGITS)
    for _ in range(3):
        if end >= len(text) or text[end] != "." or (part := run_right(text, end + 1, DIGITS)) == end + 1:
            return None
        end = part
    return at, end


def card_from(text: str, at: int) -> Span | None:
    """Digits with at most one space or hyphen between two of them, two digits at least."""
    end = at + 1
    while end < len(text):
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return (at, end) if end > at + 1 else None


def phone_from(text: str, at: int) -> Span | None:
    """A plus sign, a digit, marks and digits, and a digit at the end."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = run_right(text, at + 1, PHONE)
    while text[end - 1] not in DIGITS:
        end -= 1
    return (at, end) if end >= at + 4 else None


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * int(d) - 9 * (d > "4") for d in even)) % 10 == 0


def valid(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in value.split("."))
    digits = "".join(c for c in value if c in DIGITS)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def login_at(text: str, at: int) -> Span | None:
    """name:word@ after a scheme; `at` is the place of ://"""
    start = at + 3
    end = run_right(text, start, LOCAL | frozenset(":~!$&'()*,;="))
    if end < len(text) and text[end] == "@" and ":" in text[start:end]:
        return start, end
    return None


def key_at(text: str, at: int) -> Span | None:
    """An access key: its mark at the start of a token of capitals and digits of one length."""
    if at and text[at - 1] in SECRET:
        return None
    # one character more than a key has tells whether the token ends there
    length = run_right(text[at : at + KEY_LENGTH + 1], 0, KEY)
    return (at, at + length) if length == KEY_LENGTH else None


def grouped(text: str, at: int, among: frozenset[str], most: int | None = None) -> Iterator[tuple[int, int]]:
    """Groups of some characters with one space or hyphen between two: for each, its end and the characters so far."""
    count = 0
    while True:
        end = run_right(text, at, among)
        count += end - at
        if end == at or most is not None and count > most:
            return
        yield end, count
        if end >= len(text) or text[end] not in " -":
            return
        at = end + 1


def mod_97(value: str) -> bool:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def account_from(text: str, at: int) -> Span | None:
    """An IBAN whose checksum is right, or digits; both may be grouped by spaces and hyphens."""
    best = None
    for end, count in grouped(text, at, LETTERS | DIGITS, IBAN[1]):
        value = text[at:end].replace(" ", "").replace("-", "")
        if not (value[:2].isalpha() and value[2:4].isdigit()) and count >= 4:
            break
        if count >= IBAN[0] and mod_97(value):
            best = end
    if best:
        return at, best
    last, digits = at, 0
    for last, digits in grouped(text, at, DIGITS):
        pass
    token = run_right(text, at, SECRET)
    if digits >= SHORTEST and last >= token:
        return at, last
    return (at, token) if token - at >= SHORTEST and any(c in DIGITS for c in text[at:token]) else None


def value_after(text: str, at: int, kind: str) -> Span | None:
    """The value that a cue announces, after marks: an account, or a token with a digit in it."""
    start = at
    while start < len(text) and text[start] in " :=#\"'":
        start += 1
    if start == at:
        return None
    if kind == "account":
        return account_from(text, start)
    end = run_right(text, start, SECRET)
    if SHORTEST <= end - start and any(c in DIGITS for c in text[start:end]):
        return start, end
    return None


class Finder:
    """All spans of a text from one pass of the automaton over it."""

    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for mark in ("@", "+", "://", KEY_MARK, *DIGITS):
            self.automaton.add_word(mark.lower(), (mark, len(mark)))
        for kind, words in CUES.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> dict[str, list[Span]]:
        """Spans by kind. Matches of a base kind don't overlap; one that fails its test uses up its text all the same."""
        matched: dict[str, list[Span]] = {k: [] for k in (*BASE, *ADDED)}
        free = dict.fromkeys(matched, 0)

        def take(kind: str, span: Span | None) -> None:
            if span and span[0] >= free[kind]:
                free[kind] = span[1]
                if valid(kind, text[span[0] : span[1]]):
                    matched[kind].append(span)

        number = 0  # end of the run of digits looked at
        for last, (mark, length) in self.automaton.iter(folded(text)):
            at = last - length + 1
            if mark == "@":
                take("email", email_at(text, at, free["email"]))
            elif mark == "+":
                if at >= free["phone"]:
                    take("phone", phone_from(text, at))
            elif mark == "://":
                take("url_login", login_at(text, at))
            elif mark == KEY_MARK:
                if text.startswith(KEY_MARK, at):
                    take("secret", key_at(text, at))
            elif mark in DIGITS:
                if at >= free["card"]:
                    take("card", card_from(text, at))
                if at >= number or free["ip"] == at:
                    number = run_right(text, at, DIGITS)
                    if at >= free["ip"]:
                        take("ip", ip_from(text, at))
            else:
                take(mark, value_after(text, last + 1, mark))
        return matched


SPANS = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def written(found: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in sorted(found[k]))


def find_pii(docs: DataFrame) -> DataFrame:
    """Personal data in every whole text.

    An automaton reads each text once for at-signs, plus signs, schemes, digits and words that announce identifiers.
    From each anchor a parser walks to both ends of the span, and a test decides (parts of an address up to 255, Luhn's sum
    of a card, digits of a phone). Base kinds are email, ip, card, phone, leftmost and non-overlapping per kind. Added
    ones are logins in addresses of the web, values after a cue in any case (account, national_id,
    secret), and access keys. Accounts may be grouped; an IBAN's checksum tells where a grouped one ends.

    Null text is empty and has no spans. No row depends on another, so repeated rows get equal results, and only the
    text of one Arrow batch is in memory. Places are code points. Other columns are not read.
    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["_text"], strict=True):
                found = finder(text)
                base = hashlib.sha256(written(found, BASE).encode()).hexdigest()
                counts = [len(found[k]) for k in BASE]
                rows.append((doc_id, *counts, base, written(found, BASE + ADDED), sum(len(found[k]) for k in ADDED)))
            names = [c.split()[0] for c in SPANS.split(", ")]
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("_text")).mapInPandas(run, SPANS)
