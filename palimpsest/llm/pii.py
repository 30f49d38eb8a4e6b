"""Personal data in whole texts, by anchors and local parsers.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, URL
schemes and words that announce an identifier. From each anchor a deterministic
parser expands to the borders of the item and checks it. Spans are code points,
end exclusive, leftmost and non-overlapping within a kind.

Base kinds: email, ip (four parts of at most 255), card (14 to 19 digits passing
the Luhn check), phone (10 to 15 digits after a plus sign). A candidate that
fails its check is dropped and the search goes on after it. Further kinds: url
(after a scheme or "www.") and account (an identifier with a digit after a cue
such as "iban" or "ssn"; international account numbers by their length and
remainder). Null and empty texts have no spans; repeated rows are read each for
itself, and other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import with_fields

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")

# The character classes of the base patterns.
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
DIGITS = frozenset("0123456789")
PHONE = DIGITS | frozenset(" ().-")

# Schemes and cues are met in any case of A-Z.
SCHEMES = ("http://", "https://", "ftp://", "www.")
URL_STOP = frozenset(" \t\n\r\x0b\x0c\"'<>`{}|\\^ ")
URL_TRAIL = frozenset(".,;:!?)]")
CUES = ("iban", "ssn", "account", "passport", "konto", "compte", "cuenta")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Signs of an international account number.
IBAN_LENGTHS = range(15, 35)
_FOLD = {c: c + 32 for c in range(65, 91)}
ACCOUNT = ALNUM | frozenset("-")


@lru_cache(1)
def anchors():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for digit in DIGITS:
        automaton.add_word(digit, ("digit", 1))
    automaton.add_word("@", ("at", 1))
    automaton.add_word("+", ("plus", 1))
    for scheme in SCHEMES:
        automaton.add_word(scheme, ("url", len(scheme)))
    for cue in CUES:
        automaton.add_word(cue, ("account", len(cue)))
    automaton.make_automaton()
    return automaton


def expand_email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around an at-sign; nothing before ``floor`` is taken."""
    start, n = at, len(text)
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    end = at + 1
    while end < n and text[end] in LABEL:
        end += 1
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end += 2
        labels += 1
        while end < n and text[end] in LABEL:
            end += 1
    return (start, end) if labels else None


def expand_ip(text: str, start: int) -> tuple[int, bool, int]:
    """(end, whether it is an address, where to look on) from the first digit of a run."""
    n, at, parts = len(text), start, []
    while True:
        end = at
        while end < n and text[end] in DIGITS:
            end += 1
        parts.append(text[at:end])
        if len(parts) == 4:
            return end, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts), end
        if not (end + 1 < n and text[end] == "." and text[end + 1] in DIGITS):
            return end, False, end
        at = end + 1


def expand_card(text: str, start: int) -> tuple[int, bool]:
    """The whole chain of digits with single blanks or hyphens between, and whether it is a card number."""
    n, end, digits = len(text), start, []
    while True:
        if end < n and text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif end + 1 < n and text[end] in " -" and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return end, 14 <= len(digits) <= 19 and luhn(digits)


def luhn(digits: list[str]) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def expand_phone(text: str, plus: int) -> tuple[int, bool]:
    n, end = len(text), plus + 1
    if not (end < n and text[end] in DIGITS):
        return plus + 1, False
    while end < n and text[end] in PHONE:
        end += 1
    while text[end - 1] not in DIGITS:
        end -= 1
    if end - plus < 4:  # a digit, one more sign at least, a digit
        return plus + 1, False
    return end, 10 <= sum(c in DIGITS for c in text[plus:end]) <= 15


def expand_url(text: str, start: int, size: int) -> tuple[int, int] | None:
    if start and text[start - 1] in ALNUM:
        return None
    end, n = start + size, len(text)
    while end < n and text[end] not in URL_STOP:
        end += 1
    while end > start + size and text[end - 1] in URL_TRAIL:
        end -= 1
    return (start, end) if end > start + size else None


def expand_iban(text: str, first: int) -> int | None:
    """The end of the international account number that begins here: groups of capitals and digits, blanks between, remainder 1 by 97."""
    if not (text[first : first + 2].isascii() and text[first : first + 2].isalpha() and text[first : first + 2].isupper() and text[first + 2 : first + 4].isascii() and text[first + 2 : first + 4].isdigit() and len(text) >= first + 4):
        return None
    n, end, signs, best = len(text), first, [], None
    while end < n and len(signs) <= IBAN_LENGTHS[-1]:
        c = text[end]
        if c in DIGITS or c in UPPER:
            signs.append(c)
            end += 1
            if len(signs) in IBAN_LENGTHS and (end == n or text[end] not in ALNUM) and int("".join(str(int(s, 36)) for s in signs[4:] + signs[:4])) % 97 == 1:
                best = end
        elif c == " " and end + 1 < n and (text[end + 1] in DIGITS or text[end + 1] in UPPER):
            end += 1
        else:
            break
    return best


def expand_account(text: str, start: int, size: int) -> tuple[int, int] | None:
    """The identifier after a cue: an international account number, else groups of letters and digits, six signs or more with a digit."""
    n, at = len(text), start + size
    if (start and text[start - 1] in ALNUM) or (at < n and text[at] in ALNUM):
        return None
    for _ in range(3):  # "no.", "number", ":" and the like stand between
        while at < n and text[at] in " :#.=":
            at += 1
        word = at
        while word < n and text[word].isalpha() and text[word].islower():
            word += 1
        if word - at in range(1, 8) and word < n and text[word] in " :#.=":
            at = word
    first = at
    if end := expand_iban(text, first):
        return first, end
    end = at
    while end < n and (text[end] in ACCOUNT or (text[end] == " " and end + 1 < n and text[end + 1] in DIGITS and text[end - 1] in ALNUM)):
        end += 1
    while end > first and text[end - 1] not in ALNUM:
        end -= 1
    found = text[first:end]
    return (first, end) if sum(c in ALNUM for c in found) >= 6 and any(c in DIGITS for c in found) else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed in KINDS."""
    spans = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (what, size) in anchors().iter(text.translate(_FOLD)):
        if what == "digit":
            if last >= ip_end:
                end, good, ip_end = expand_ip(text, last)
                if good:
                    spans.append((last, end, "ip"))
            if last >= card_end:
                end, good = expand_card(text, last)
                card_end = end
                if good:
                    spans.append((last, end, "card"))
        elif what == "at":
            found = expand_email(text, last, email_end)
            if found:
                email_end = found[1]
                spans.append((*found, "email"))
        elif what == "plus":
            if last >= phone_end:
                phone_end, good = expand_phone(text, last)
                if good:
                    spans.append((last, phone_end, "phone"))
        elif what == "url":
            if last - size + 1 >= url_end:
                found = expand_url(text, last - size + 1, size)
                if found:
                    url_end = found[1]
                    spans.append((*found, "url"))
        elif last - size + 1 >= account_end:
            found = expand_account(text, last - size + 1, size)
            if found and found[0] >= account_end:
                account_end = found[1]
                spans.append((*found, "account"))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def detect_pii(df: DataFrame, text_col: str = "text", span_col: str = "pii_spans") -> DataFrame:
    """df with ``span_col``, an array of (kind, start, end) per row; a column by that name is replaced."""
    kept = df.drop(span_col)
    at, names = kept.columns.index(text_col), [*kept.columns, span_col]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(at):
                text = value.as_py()
                found.append([{"kind": k, "start": a, "end": b} for a, b, k in find_spans(text)] if text else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, SPAN_TYPE)], names=names)

    return kept.mapInArrow(kernels.tidy(run), with_fields(kept.schema, **{span_col: "array<struct<kind:string,start:bigint,end:bigint>>"}))


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, where spans overlap the first, replaced by its kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def span_digests(found: DataFrame, span_col: str = "pii_spans") -> DataFrame:
    """doc_id and the counts, the digest of base spans and the list of all spans."""
    spans = F.col(span_col)
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of one text's spans, for tests and single texts."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in BASE_KINDS).encode()).hexdigest()
