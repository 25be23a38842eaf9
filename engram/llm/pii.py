"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and cues of accounts and
street addresses. From each anchor a deterministic local parser expands left and right and validates: an email around its
at-sign, an IP address or card number from the first digit of a run, a phone number from its plus sign (these four are
the base kinds: leftmost, not overlapping within a kind, failing matches dropped without a retry), and beyond them a URL
around its scheme, an IBAN or account number after its cue, a street address around its cue, and a secret: the value that a
cue such as token or password assigns, a key of a well-known form, or a private key's header. Each parser starts at or
after the end of its kind's last match, so the work is linear in the text.

Positions are code points, ends exclusive. Null and odd input: a null text is empty and has no spans; texts of any
length are scanned whole; null doc_ids, repeated rows and empty tables go through row by row; only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from engram.llm.bpe import parts
from engram.llm.common import documents, integer_ids

BASE = ("email", "ip", "card", "phone")
EXTRA = ("url", "account", "address", "secret")
ORDER = {k: i for i, k in enumerate(BASE + EXTRA)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
REST_OF_URL = re.compile(r"[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
IBAN = re.compile(r"[\s:#.-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\s*(?:number|no|nr|num))?[\s:#.=-]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9])", re.IGNORECASE)
#: At most 135 characters, so that no more than STREET_REACH before a cue need be looked at.
STREET_REACH = 140
STREET_LEFT = re.compile(r"([0-9]{1,5}[A-Za-z]?(?: [A-Z][A-Za-z.'-]{0,30}){1,4} )\Z")
STREET_RIGHT = re.compile(r"[ ,]+([0-9]{1,5}[A-Za-z]?)\b")
SCHEMES = ("http", "https", "ftp")
IBAN_CUES = ("IBAN", "iban", "Iban")
ACCOUNT_CUES = ("account", "Account", "acct", "Acct", "konto", "Konto", "compte", "Compte", "cuenta", "Cuenta")
#: Street words after the number and name, and those that stand before or in them.
STREET_AFTER = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
STREET_WITHIN = ("straße", "strasse", "Straße")
#: Names that a secret is assigned to, in lower, upper and title case; what stands between name and value; the value, which
#: must hold a digit.
SECRET_CUES = tuple(f(w) for w in ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key", "private_key") for f in (str.lower, str.upper, str.title))
SECRET = re.compile(r"[\"']?[ \t]{0,4}(?:=|:)[ \t]{0,4}[\"']?([A-Za-z0-9_./+~=-]{8,})")
#: Forms of well-known keys, by how they begin.
KEY_FORMS = {
    "AKIA": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"),
    "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}(?![0-9A-Za-z])"),
    "-----BEGIN ": re.compile(r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (
        ("email", "@"), ("phone", "+"), ("digit", DIGITS), ("url", ("://",)), ("iban", IBAN_CUES),
        ("account", ACCOUNT_CUES), ("after", STREET_AFTER), ("within", STREET_WITHIN),
        ("secret", SECRET_CUES), ("key", KEY_FORMS),
    ):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, in the order of start, then kind, then end."""
    out: list[tuple[int, int, str]] = []
    after = dict.fromkeys(ORDER, 0)  # where a kind's last match ended
    run = -1  # the end of the digit run last seen
    barren = 0  # the end of the value last seen that has no digit

    def keep(kind: str, start: int, end: int) -> None:
        after[kind] = end
        out.append((start, end, kind))

    for last, (cue, n) in AUTOMATON.iter(text):
        at = last - n + 1
        if cue == "digit":
            fresh, run = at != run, at + 1
            if not fresh:
                continue
            if at >= after["ip"] and (m := IP.match(text, at)):
                after["ip"] = m.end()
                if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    keep("ip", at, m.end())
            if at >= after["card"] and (m := CARD.match(text, at)):
                after["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    keep("card", at, m.end())
        elif cue == "email":
            start = at
            while start > after["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                keep("email", start, m.end())
        elif cue == "phone":
            if m := PHONE.match(text, at):
                if 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                    keep("phone", at, m.end())
        elif cue == "url":
            scheme = next((s for s in sorted(SCHEMES, key=len, reverse=True) if text[max(0, at - len(s)) : at].lower() == s), None)
            if scheme and at - len(scheme) >= after["url"] and (m := REST_OF_URL.match(text, at + 3)):
                end = m.end()
                while text[end - 1] in ".,;:!?)":
                    end -= 1
                if end > at + 3:
                    keep("url", at - len(scheme), end)
        elif cue == "iban":
            if m := IBAN.match(text, last + 1):
                # The longest valid reading; words may follow a code after a blank.
                code = m[1]
                while len(code) >= 15 and not iban_holds(code):
                    code = code[:-1].rstrip()
                if len(code) >= 15 and m.start(1) >= after["account"]:
                    keep("account", m.start(1), m.start(1) + len(code))
        elif cue == "account":
            if (m := ACCOUNT.match(text, last + 1)) and m.start(1) >= after["account"]:
                keep("account", m.start(1), m.end(1))
        elif cue == "secret":
            # A cue before the last character of a secret, or of a value without a digit, has its value in there too.
            if last + 2 >= max(after["secret"], barren) and (m := SECRET.match(text, last + 1)) and m.start(1) >= after["secret"]:
                if any(c in DIGITS for c in m[1]):
                    keep("secret", m.start(1), m.end(1))
                else:
                    barren = m.end(1)
        elif cue == "key":
            if at >= after["secret"] and (m := KEY_FORMS[text[at : last + 1]].match(text, at)):
                keep("secret", at, m.end())
        elif cue == "after":
            left = max(after["address"], at - STREET_REACH)
            if m := STREET_LEFT.search(text[left:at]):
                keep("address", left + m.start(1), last + 1)
        elif m := STREET_RIGHT.match(text, last + 1):
            start = at
            while start > after["address"] and text[start - 1].isalpha():
                start -= 1
            keep("address", start, m.end(1))
    out.sort(key=lambda s: (s[0], ORDER[s[2]], s[1]))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in parts(whole):
            found = [find(t) if t else [] for t in b.column(1).to_pylist()]
            columns = [pa.array([sum(s[2] == k for s in f) for f in found], pa.int64()) for k in BASE]
            base = [hashlib.sha256(joined([s for s in f if s[2] in BASE]).encode()).hexdigest() for f in found]
            more = [pa.array([sum(s[2] == "secret" for s in f) for f in found], pa.int64()), pa.array([sum(s[2] != "url" for s in f) for f in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *columns, pa.array(base, pa.string()), pa.array([joined(f) for f in found], pa.string()), *more],
                ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_secret", "n_private"],
            )


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_private) for each row; n_private counts all spans
    but URLs."""
    return integer_ids(docs.select("doc_id", "text"), "doc_id").mapInArrow(
        _run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_private long"
    )


def redact(text: str) -> str:
    """The text with each span, or overlapping spans together, replaced by its kind in angle brackets."""
    out, at = [], 0
    for start, end, kind in find(text):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def op8_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(documents(spark, sf_dir))
