"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the characters and cue words that any
personal datum must hold: at-signs, plus signs, digits, scheme marks and the
words that announce an identifier.  At each anchor a local parser expands to
the exact bounds and checks them (number ranges, digit counts, Luhn, IBAN
check digits).  Bounds are code points, ends exclusive.

Base kinds follow their patterns leftmost and without overlap in a kind; a
match that fails its check is dropped and not tried again from inside.  The
method adds web addresses (``url``) and announced identifiers (``account``);
an added span never replaces or overlaps a base one: an announced value that
holds base spans is its parts beside them.

An announced value has no greatest length.  After ``iban`` it is letters and
digits, in groups or not, with right check digits.  After the cues of
``SECRETS`` it is a run of token characters (for passwords, of all but white
space; in quotes, up to the closing one) that is announced by a mark such as a
colon or else holds letters and digits.  After the others it is an identifier
with four digits at least, in groups of digits or not.

Defined results: null text is empty text and has no spans; a null id stays
null; each repeated row gets its own result; extra columns are ignored by
``find_spans`` and kept by ``redact``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bound_batches, by_text_size, texts_of

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
RESULT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

#: Words that announce an identifier (fixed values); matched at a word's start in any case.
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "member id", "user id", "password", "passwd", "token", "api_key", "apikey", "secret")
PASSWORDS = ("password", "passwd")
SECRETS = (*PASSWORDS, "token", "api_key", "apikey", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_URL_REST = re.compile(r"[^\s<>\"'`]+")
_LEAD = re.compile(r"[\"']?(?:[\x20\t]{0,4}(?:number|num|no|nr|id)\b\.?)?[\x20\t]{0,4}(:=|=>|[:=#]|is\b)?[\x20\t]{0,4}", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[\"']?([0-9]{2,6}(?:\x20[0-9]{2,6})+(?![A-Za-z0-9])|[A-Za-z0-9][A-Za-z0-9._/+=-]{3,})")
_IBAN = re.compile(r"[\"']?([A-Za-z]{2}[0-9]{2}(?:[\x20-]?[A-Za-z0-9]){11,30})")
_QUOTED = re.compile(r"([\"'])([^\r\n]*?)\1")
_PASSWORD = re.compile(r"[\"']?([^\s<>]+)")
_TOKEN = re.compile(r"[\"']?([A-Za-z0-9._~/+=%$:-]+)")

_automaton = None


def _anchors():
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for x in ("@", "+", "://", *"0123456789"):
            a.add_word(x, x)
        for cue in CUES:
            a.add_word(cue, cue)
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        n = ord(x) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    text = text.replace("-", "").replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(x, 36)) for x in text[4:] + text[:4])) % 97 == 1


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


_ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def _lower(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _announced(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """Bounds of the value that ``cue``, which ends at ``at``, announces."""
    lead = _LEAD.match(text, at)
    at = lead.end()
    if cue == "iban":
        if m := _IBAN.match(text, at):
            a = m.start(1)
            for b in range(m.end(1), a + 14, -1):
                if not text[b : b + 1].isalnum() and text[b - 1].isalnum() and iban(text[a:b]):
                    return a, b
        return None
    if cue not in SECRETS:
        if m := _IDENTIFIER.match(text, at):
            found = m[1].rstrip("._/+=-")
            if sum(x in _DIGITS for x in found) >= 4:
                return m.start(1), m.start(1) + len(found)
        return None
    marked = (lead[1] or "is").lower() != "is"
    if marked and (m := _QUOTED.match(text, at)) and len(m[2]) >= 4:
        a, found = m.start(2), m[2]
    elif m := (_PASSWORD if cue in PASSWORDS else _TOKEN).match(text, at):
        a, found = m.start(1), m[1].rstrip(".,;:)]}\"'")
    else:
        return None
    digits, letters = sum(x in _DIGITS for x in found), any(x.isalpha() for x in found)
    good = digits >= 4
    if marked:
        good |= len(found) >= 4 and (cue in PASSWORDS or not found.isalpha() or len(found) >= 16)
    elif lead.end() > lead.start():
        good |= len(found) >= 6 and letters and digits > 0
    return (a, a + len(found)) if good else None


class _Taken:
    """Base spans by start; the greatest end so far tells where those that reach a place begin."""

    def __init__(self, base: list[tuple[str, int, int]]):
        self.spans = sorted((a, b) for _, a, b in base)
        self.reach = list(accumulate((b for _, b in self.spans), max))

    def meeting(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        for k in range(bisect_right(self.reach, a), len(self.spans)):
            x, y = self.spans[k]
            if x >= b:
                return
            if y > a:
                yield x, y

    def beside(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """Parts of ``a`` to ``b`` outside all spans."""
        for x, y in self.meeting(a, b):
            if a < x:
                yield a, x
            a = max(a, y)
        if a < b:
            yield a, b


def spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind in the order of ``KINDS``."""
    base: list[tuple[str, int, int]] = []
    more: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = url_end = account_end = 0
    for last, anchor in _anchors().iter(_lower(text)):
        if anchor in _DIGITS:
            if last and text[last - 1] in _DIGITS:
                continue  # inside a run of digits; its start has been tried
            if last >= ip_end and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(map(_byte, m[0].split("."))):
                    base.append(("ip", last, ip_end))
            if last >= card_end and (m := _CARD.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    base.append(("card", last, card_end))
        elif anchor == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                base.append(("email", start, email_end))
        elif anchor == "+":
            if m := _PHONE.match(text, last):
                if 9 <= sum(x in _DIGITS for x in m[0]) <= 15:
                    base.append(("phone", last, m.end()))
        elif anchor == "://":
            at = last - 2
            start = at
            while start > url_end and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not text[start].isalpha():
                start += 1
            if start < at and (rest := _URL_REST.match(text, last + 1)) and (host := rest[0].rstrip(".,;:!?)]}")):
                url_end = last + 1 + len(host)
                more.append(("url", start, url_end))
        else:
            first = last - len(anchor) + 1
            if first >= account_end and not (first and text[first - 1].isalnum()) and (found := _announced(text, anchor, last + 1)):
                account_end = found[1]
                more.append(("account", *found))
    added, taken = [], _Taken(base)
    for kind, a, b in more:
        if kind == "account":
            added += [(kind, x, y) for x, y in taken.beside(a, b) if any(c.isalnum() for c in text[x:y])]
        elif next(taken.meeting(a, b), None) is None:
            added.append((kind, a, b))
    base += added
    base.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return base


def _join(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digest and spans of every whole text."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                found = spans(text)
                base = [s for s in found if s[0] in BASE]
                rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(found)))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)


def redact_text(text: str, kinds: tuple[str, ...]) -> str:
    """Spans of ``kinds`` become ``<KIND>``; of overlapping ones the earliest names the place."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in spans(text):
        if kind not in kinds:
            continue
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = (*BASE, "account")) -> DataFrame:
    """The same rows and columns with personal data replaced; null text stays null."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_text_size(batches, text_col):
            new = [None if x is None else redact_text(x, kinds) for x in batch.column(text_col).to_pylist()]
            cols = batch.columns
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema.set(at, pa.field(text_col, pa.string())))

    return docs.mapInArrow(run, docs.schema)
