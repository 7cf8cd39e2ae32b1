"""Base kinds against their regular expressions; offsets; added kinds."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from varve.llm.pii import ACCOUNT_CUES, AFTER_ACCOUNT, KINDS, SECRET_CUES, _machine, find_personal_data, find_spans, iban_valid, luhn

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
MACHINE = _machine()


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in text.split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]()


def brute(text):
    return {k: [m.span() for m in re.finditer(p, text) if valid(k, m[0])] for k, p in PATTERNS.items()}


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "-", "+", " ", "(", ")", "1", "4", "5", "255", "256", "00", "é", "x.y", "4444", "4242424242424242", "+1 (555) 222-3333", "b@c.de", "10.0.0.1", "\n", "_", "%"]), max_size=25).map("".join))
def test_base_spans_are_the_regexes(text):
    got = find_spans(text, MACHINE)
    assert {k: got[k] for k in PATTERNS} == brute(text)


def test_rows(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "Écrire à bob.x@mail.example.com, IP 10.1.2.3; appelez +1 (319) 555-5132. Carte 4242 4242 4242 4242"), (3, "again a@b.c"), (None, "IBAN: DE89 3704 0044 0532 0130 00 account no. 12345678, password=abc123def9 http://user:pw1@host/")]
    got = {(r.doc_id, r.n_email): r for r in find_personal_data(make_docs(rows)).collect()}
    assert got[1, 0].spans == "" and got[1, 0].base_sha256 == hashlib.sha256(b"").hexdigest()
    text = rows[2][1]
    twice = {r.spans: r for r in find_personal_data(make_docs(rows)).collect() if r.doc_id == 3}
    assert len(twice) == 2 and "email:6:11" in twice
    (r,) = [r for spans, r in twice.items() if spans != "email:6:11"]
    cut = {k: text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(","))}
    assert cut == {"email": "bob.x@mail.example.com", "ip": "10.1.2.3", "phone": "+1 (319) 555-5132", "card": "4242 4242 4242 4242"}
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    kinds = [s.split(":")[0] for s in got[None, 0].spans.split(",")]
    assert kinds == ["account", "account", "login", "secret"]
    assert list(dict.fromkeys(kinds)) == [k for k in KINDS if k in kinds]
    assert find_personal_data(make_docs([])).count() == 0


def added_brute(text):
    """The added kinds by patterns over the whole text, cue by cue."""
    out = {"account": set(), "login": set(), "secret": set()}
    forms = lambda cue: {cue, cue.capitalize(), cue.upper()}
    for m in re.finditer(r"(?<=://)[^\s/?#@:]+:[^\s/?#@]+(?=@)", text):
        out["login"].add(m.span())
    for cue in (f for c in SECRET_CUES for f in forms(c)):
        for m in re.finditer(rf"(?=(?<![^\W_]){re.escape(cue)} {{0,2}}[:=] {{0,2}}[\"']?([A-Za-z0-9_\-./+]{{8,}}))", text):
            if any(c.isdigit() for c in m[1]):
                out["secret"].add(m.span(1))
    for cue in (f for c in ACCOUNT_CUES for f in forms(c)):
        for m in re.finditer(rf"(?=(?<![^\W_]){re.escape(cue)}{AFTER_ACCOUNT.pattern[5:]})", text, re.I | re.A):
            if text[m.start() : m.start() + len(cue)] == cue and (m[1][0].isdigit() or iban_valid(m[1])):
                out["account"].add(m.span(1))
    for start in range(len(text)):
        if start and text[start - 1].isalnum() or not re.match("[A-Z]{2}[0-9]{2}", text[start:]):
            continue
        for end in range(min(len(text), start + 68), start, -1):
            if re.fullmatch("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", text[start:end]) and not re.match("[A-Za-z0-9]", text[end:]) and iban_valid(text[start:end]):
                out["account"].add((start, end))
                break
    return {k: sorted(v) for k, v in out.items()}


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ":", "=", " ", "://", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE", "89", "1234567", " no. ", "iban", "Account", "konto", "password", "TOKEN", "api key", "abc123def9", "user", "x", ".", "é", "\n", "_", '"']), max_size=16).map("".join))
def test_added_spans_are_the_patterns(text):
    got = find_spans(text, MACHINE)
    assert {k: got[k] for k in ("account", "login", "secret")} == added_brute(text)


def test_time_grows_with_the_length():
    million = 1_000_000
    assert find_spans("9" * million + ".1.2.3", MACHINE)["ip"] == []
    assert find_spans("0" * million + "1.1.2.3", MACHINE)["ip"] == [(0, million + 7)]
    texts = ["9" * million, "1." * (million // 2), "1 " * (million // 2), "1-2." * (million // 4), "+1" * (million // 2), "a@" * (million // 2), "a@b" * (million // 3), "://a:b" * (million // 6), "token=" * (million // 6), "AB12" * (million // 4), "AB12 " * (million // 5), "account " * (million // 8), "+1((((" * (million // 6), "a" * million + "@", "@" + "a" * million]
    for text in texts:
        start = time.process_time()
        find_spans(text, MACHINE)
        assert time.process_time() - start < 5, text[:10]
