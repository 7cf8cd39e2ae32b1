"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, dots, digits, scheme marks and
identifier cues. Deterministic local parsers expand each anchor and validate what they find: a dot between
digits expands to its chain of numbers, a digit to its run of digits. Runs, chains and addresses are read
once; an account number is read from each place where one can begin, over 68 characters at most, with its
check digits carried on from word to word. So the time grows with the length of the text and no faster. The
base kinds email, ip, card and phone equal the leftmost non-overlapping matches of these patterns, failing matches
dropped:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)      parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                       16 to 19 digits that pass Luhn's test
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                 8 to 15 digits

The method adds spans of kinds beyond these: ``account`` (an IBAN with valid check digits, the longest that
ends with a word, or digits after an account cue), ``secret`` (the value after a password, token
or key cue) and ``login`` (user information before the at-sign of a URL). Added spans never replace
base ones.

Edge cases: a null or empty text has no spans; offsets are code points, ends exclusive; a match is
searched for again only after the end of the one before, also when that one was dropped. Repeated rows
give repeated results. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

KINDS = ("email", "ip", "card", "phone", "account", "login", "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABELS = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])*")
PHONE_REST = re.compile(r"[0-9][ ().0-9-]+[0-9]")
SEPARATORS = {ord(c): None for c in " -().+"}
#: Cues of identifiers, in lower case.
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwort", "secret", "token", "api_key", "apikey", "api key", "private key")
AFTER_ACCOUNT = re.compile(r"(?ai)(?: ?(?:no|nr|number|num|#))?\.?[ :=#]{1,3}([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){8,30}|[0-9](?:[ -]?[0-9]){6,17})(?![A-Za-z0-9])")
AFTER_SECRET = re.compile(r"""[ ]{0,2}[:=][ ]{0,2}["']?([A-Za-z0-9_\-./+]{8,})""")
USER = re.compile(r"[^\s/?#@:]+:[^\s/?#@]+(?=@)")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
DIGIT = frozenset("0123456789")
LETTER_VALUES = {ord("A") + k: str(10 + k) for k in range(26)}


def _machine() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for word, what in [("@", "at"), ("+", "plus"), (".", "dot"), ("://", "scheme"), *((c, "digit") for c in DIGIT), *((c, "account") for c in ACCOUNT_CUES), *((c, "secret") for c in SECRET_CUES)]:
        for form in {word, word.capitalize(), word.upper()}:
            machine.add_word(form, (len(form), what))
    machine.make_automaton()
    return machine


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    t = text.replace(" ", "").upper()
    if not 15 <= len(t) <= 34:
        return False
    return int((t[4:] + t[:4]).translate(LETTER_VALUES)) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """Boundaries of the address around the at-sign at ``at``, not before ``floor``."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at:
        return None
    m = LABELS.match(text, at + 1)
    return (start, m.end()) if m else None


def _phone(text: str, plus: int, floor: int) -> tuple[int, int] | None:
    if plus < floor:
        return None
    m = PHONE_REST.match(text, plus + 1)
    return (plus, m.end()) if m else None


def _account(text: str, end: int) -> tuple[int, int] | None:
    m = AFTER_ACCOUNT.match(text, end)
    if not m or m[1][:1].isalpha() and not iban_valid(m[1]):
        return None
    return m.span(1)


def _chain(text: str, dot: int, floor: int) -> tuple[list[tuple[int, int]], int]:
    """Addresses in the chain of numbers joined by single dots around ``dot``, and the chain's end."""
    start = dot
    while start > floor and text[start - 1] in DIGIT:
        start -= 1
    m = NUMBERS.match(text, start)
    numbers, found, at = m[0].split("."), [], start
    for k in range(0, len(numbers) - 3, 4):
        four = numbers[k : k + 4]
        end = at + sum(map(len, four)) + 3
        if all(len(n.lstrip("0")) < 4 and int(n.lstrip("0") or "0") <= 255 for n in four):
            found.append((at, end))
        at = end + 1
    return found, m.end()


def _iban(text: str, digit: int) -> tuple[int, int] | None:
    """An IBAN whose first check digit is at ``digit``: the longest valid one that ends with a word."""
    start = digit - 2
    if start < 0 or start and text[start - 1].isalnum():
        return None
    m = IBAN.match(text, start)
    if not m:
        return None
    # the remainder of what follows the first four characters, carried on from word to word
    rest, length, end, found = 0, 0, start + 4, None
    head = int(text[start:end].translate(LETTER_VALUES))
    for k, word in enumerate(text[end : m.end()].split(" ")):
        value = word.translate(LETTER_VALUES)
        rest = int(f"{rest}{value}") % 97
        length += len(word)
        end += len(word) + (k > 0)
        if length >= 11 and (rest * 10**6 + head) % 97 == 1 and (end < m.end() or WORD_END.match(text, end)):
            found = (start, end)
    return found


def find_spans(text: str | None, machine: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, in the order of their starts."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return out
    email_floor = phone_floor = ip_floor = card_floor = 0
    size = len(text)
    for last, (length, what) in machine.iter(text):
        if what == "digit":
            if last < card_floor:
                continue
            m = DIGITS.match(text, last)
            card_floor = m.end()
            if card_floor - last >= 16 and 16 <= len(d := m[0].translate(SEPARATORS)) <= 19 and luhn(d):
                out["card"].append((last, card_floor))
            if s := _iban(text, last):
                out["account"].append(s)
        elif what == "dot":
            if ip_floor <= last - 1 and text[last - 1] in DIGIT and last + 1 < size and text[last + 1] in DIGIT:
                found, ip_floor = _chain(text, last, ip_floor)
                out["ip"] += found
        elif what == "at":
            if last >= email_floor and (s := _email(text, last, email_floor)):
                out["email"].append(s)
                email_floor = s[1]
        elif what == "plus":
            if s := _phone(text, last, phone_floor):
                phone_floor = s[1]
                if 8 <= len(text[s[0] : s[1]].translate(SEPARATORS)) <= 15:
                    out["phone"].append(s)
        elif what == "scheme":
            if m := USER.match(text, last + 1):
                out["login"].append(m.span())
        else:
            start = last - length + 1
            if start and text[start - 1].isalnum():
                continue
            if what == "account":
                if s := _account(text, last + 1):
                    out["account"].append(s)
            elif m := AFTER_SECRET.match(text, last + 1):
                if any(c.isdigit() for c in m[1]):
                    out["secret"].append(m.span(1))
    out["account"] = sorted(set(out["account"]))
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document with its spans; the base kinds are counted and digested apart."""

    def make():
        machine = _machine()

        def work(rows: list[dict]) -> list[dict]:
            out = []
            for r in rows:
                s = find_spans(r["text"], machine)
                base = joined(s, KINDS[:4])
                out.append({"doc_id": r["doc_id"], **{f"n_{k}": len(s[k]) for k in KINDS[:4]}, "base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": joined(s, KINDS)})
            return out

        return work

    return map_arrow(docs.select(F.col("doc_id"), "text"), make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
