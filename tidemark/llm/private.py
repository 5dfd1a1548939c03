"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the places where personal data can be: at-signs, schemes, plus
signs, digits, words that announce an account number, and words and prefixes that announce a secret. From each such anchor a small
deterministic parser walks outwards to the exact limits and checks what it found. All parsers are
linear in the characters they walk over, and none walks over the same stretch twice, so long runs of
digits or of local parts cost no more than any other text.

Every text is judged alone: there is no shuffle, and a task holds one batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import text_slices, without

#: The base kinds, in the order in which spans are listed, and the kinds the anchors add.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("url", "account", "secret")

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
LOCAL_PART = frozenset(LETTERS + DIGITS + "._%+-")
PHONE_BODY = frozenset(DIGITS + " ().-")
SCHEMES = frozenset(["http", "https", "ftp", "ftps", "sftp", "ssh"])
ACCOUNT_CUES = ("iban", "Iban", "IBAN", "account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "konto", "Konto", "KONTO")

SECRET_WORDS = ("password", "passwd", "passphrase", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "client_key", "auth_key")
SECRET_CUES = tuple(form for word in SECRET_WORDS for form in (word, word.capitalize(), word.upper()))
# How secrets of well-known services begin, and what follows, by its characters and length.
SECRET_FORMS = {
    "AKIA": r"[A-Z0-9]{16}",
    "ASIA": r"[A-Z0-9]{16}",
    "ghp_": r"[A-Za-z0-9]{36}",
    "gho_": r"[A-Za-z0-9]{36}",
    "glpat-": r"[A-Za-z0-9_-]{20}",
    "AIza": r"[A-Za-z0-9_-]{35}",
    "xoxb-": r"[A-Za-z0-9-]{20,80}",
    "xoxp-": r"[A-Za-z0-9-]{20,80}",
    "eyJ": r"[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
}
#: Characters of a secret behind a cue, and how many at least; fewer letters and digits of both kinds are a common word.
LEAST_SECRET, MOST_SECRET = 8, 512

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_URL_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
# A host with a dot, perhaps behind a name and before a port, then a path or what ends a URL. No more is read than up to the next slash.
_HOST = re.compile(
    r"(?:[^\s<>\"'`{}|\\^/?#@]*@)?(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z0-9-]{2,63}(?::[0-9]{1,5})?"
    r"(?=[/?#]|[.,;:!?)\]]*(?:[\s<>\"'`{}|\\^]|$))"
)
_AFTER_CUE = re.compile(r"[A-Za-z0-9_]{0,16}[\"']?\s{0,2}(?::=|=>|[=:])\s{0,2}[\"']?")
_SECRET = re.compile(r"[A-Za-z0-9+/_\-.=~!@#$%^&*]" + f"{{{LEAST_SECRET},{MOST_SECRET}}}")
_FORMS = {prefix: re.compile(rest) for prefix, rest in SECRET_FORMS.items()}
_WORD_SIGN = re.compile(r"[A-Za-z0-9_-]")
_IBAN = re.compile(r"[ :=#.]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?: (?:number|num|no|nr)\b\.?)?[ :=#.]{0,3}([0-9](?:[ -]?[0-9]){7,16})(?![0-9])")

SPAN_TYPE = "array<struct<kind: string, start: int, end: int>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find_private_spans(df: DataFrame, text: str = "text", result: str = "private_spans") -> DataFrame:
    """Add an array of (kind, start, end) for the personal data in each text, by kind, then start.

    Positions count code points; the end is exclusive. Within a kind, spans don't overlap and the
    leftmost wins; spans of different kinds may.

    Edge cases: a NULL or empty text has an empty array. A very long text is scanned once, in linear
    time. Repeated rows get equal arrays. An empty table stays empty. An input column named as the
    result is replaced; all others pass through untouched.
    """

    @F.arrow_udf(SPAN_TYPE)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        anchors = anchor_automaton()
        for texts in batches:
            parts = [pa.array([spans_of(t or "", anchors) for t in part.to_pylist()], SPAN_ARROW) for part in text_slices(texts)]
            yield pa.concat_arrays(parts) if parts else pa.array([], SPAN_ARROW)

    return without(df, result).withColumn(result, spans(F.col(text)))


def redacted(text: str | Column, spans: str | Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    begins = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(
        begins,
        start,
        lambda done, s: F.when(s.end <= done.at, done).otherwise(
            F.struct(
                F.concat(
                    done.out,
                    F.substring(text, done.at + 1, F.greatest(s.start - done.at, F.lit(0))),
                    F.when(s.start >= done.at, F.concat(F.lit("<"), s.kind, F.lit(">"))).otherwise(""),
                ).alias("out"),
                s.end.alias("at"),
            )
        ),
    )
    return F.concat(walked.out, F.substring(text, walked.at + 1, F.length(text)))


def anchor_automaton() -> ahocorasick.Automaton:
    anchors = ahocorasick.Automaton()
    for word, kind in [("@", "@"), ("://", ":"), ("+", "+")] + [(d, "0") for d in DIGITS] + [(c, "a") for c in ACCOUNT_CUES] + [(c, "s") for c in SECRET_CUES]:
        anchors.add_word(word, kind)
    for prefix in SECRET_FORMS:
        anchors.add_word(prefix, prefix)
    anchors.make_automaton()
    return anchors


def spans_of(text: str, anchors: ahocorasick.Automaton) -> list[dict]:
    found: dict[str, list[tuple[int, int]]] = {kind: [] for kind in BASE_KINDS + ADDED_KINDS}
    free = dict.fromkeys((*found, "ip_run"), 0)  # where the next span of a kind may begin

    def add(kind: str, span: tuple[int, int] | None) -> None:
        if span is not None:
            found[kind].append(span)

    for last, anchor in anchors.iter(text):
        if anchor == "0":
            if last >= free["ip"]:
                spans, free["ip"] = _addresses(text, last)
                found["ip"] += spans
            if last >= free["card"]:
                span, free["card"] = _card(text, last)
                add("card", span)
        elif anchor == "@":
            span, free["email"] = _email(text, last, free["email"])
            add("email", span)
        elif anchor == "+":
            add("phone", _phone(text, last))
        elif anchor == ":" and last >= free["url"]:
            span = _url(text, last - 2, last + 1)
            free["url"] = span[1] if span else free["url"]
            add("url", span)
        elif anchor == "a" and last >= free["account"]:
            span = _account(text, last + 1)
            free["account"] = span[1] if span else free["account"]
            add("account", span)
        elif anchor == "s" and last >= free["secret"]:
            span, free["secret"] = _secret(text, last + 1)
            add("secret", span)
        elif anchor in _FORMS and last - len(anchor) + 1 >= free["secret"]:
            span = _known_form(text, last - len(anchor) + 1, anchor)
            free["secret"] = span[1] if span else free["secret"]
            add("secret", span)
    return [{"kind": kind, "start": start, "end": end} for kind, spans in found.items() for start, end in spans]


def _run_end(text: str, start: int, allowed) -> int:
    end = start
    while end < len(text) and text[end] in allowed:
        end += 1
    return end


def _email(text: str, at: int, free: int) -> tuple[tuple[int, int] | None, int]:
    """Local part to the left of the at-sign, as far as the last address ended; domain to the right.

    What lies left of an at-sign without a domain can't start another address: local parts hold no at-sign.
    """
    start = at
    while start > free and text[start - 1] in LOCAL_PART:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    if domain is None:
        return None, max(free, at + 1)
    return (start, domain.end()), domain.end()


def _addresses(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """Groups of four dotted numbers in the run of digits and dots that starts here; and its end."""
    end = _run_end(text, start, DIGITS + ".")
    spans, parts, begin = [], [], start
    at = start
    for part in text[start:end].split("."):
        if not part:
            parts = []
        else:
            begin = at if not parts else begin
            parts.append(part)
            if len(parts) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts):
                    spans.append((begin, at + len(part)))
                parts = []
        at += len(part) + 1
    return spans, end


def _card(text: str, start: int) -> tuple[tuple[int, int] | None, int]:
    """Digits with single blanks or hyphens between them; 13 to 19 digits with a right check digit."""
    digits, end = [text[start]], start + 1
    while end < len(text):
        if text[end] in DIGITS:
            digits.append(text[end])
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS:
            digits.append(text[end + 1])
            end += 2
        else:
            break
    return ((start, end) if 13 <= len(digits) <= 19 and _luhn(digits) else None), end


def _luhn(digits: list[str]) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    """A plus sign, a digit, and on to the last digit of the run of digits, blanks, brackets, dots and hyphens."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run_end(text, plus + 2, PHONE_BODY)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return (plus, end) if 9 <= sum(c in DIGITS for c in text[plus:end]) <= 15 else None


def _url(text: str, colon: int, rest: int) -> tuple[int, int] | None:
    """A known scheme to the left; to the right a host with a dot, and what follows up to a blank."""
    start = colon
    while start > 0 and colon - start < 6 and text[start - 1] in LETTERS:
        start -= 1
    if text[start:colon].lower() not in SCHEMES or _HOST.match(text, rest) is None:
        return None
    kept = _URL_REST.match(text, rest)[0].rstrip(".,;:!?)]")
    return start, rest + len(kept)


def _secret(text: str, after: int) -> tuple[tuple[int, int] | None, int]:
    """What is assigned to a word for a secret: letters and digits, both, or letters of both cases and signs; and how far was read.

    Where the characters read aren't mixed enough, those from a later cue on aren't either.
    """
    assigned = _AFTER_CUE.match(text, after)
    value = assigned and _SECRET.match(text, assigned.end())
    if not value:
        return None, after
    kept = value[0].rstrip(".,;:!?")
    has = [any(c in kind for c in kept) for kind in (DIGITS, LETTERS[:26], LETTERS[26:])]
    other = any(c not in LETTERS and c not in DIGITS for c in kept)
    mixed = (has[0] and (has[1] or has[2])) or (has[1] and has[2] and other)
    return ((value.start(), value.start() + len(kept)) if len(kept) >= LEAST_SECRET and mixed else None), value.end()


def _known_form(text: str, start: int, prefix: str) -> tuple[int, int] | None:
    """A secret told by its beginning, that stands alone and has the right length."""
    if start and _WORD_SIGN.match(text[start - 1]):
        return None
    rest = _FORMS[prefix].match(text, start + len(prefix))
    return (start, rest.end()) if rest and not _WORD_SIGN.match(text[rest.end() : rest.end() + 1]) else None


def _account(text: str, after: int) -> tuple[int, int] | None:
    """An international number with right check digits, or 8 to 17 digits, right behind its cue."""
    match = _IBAN.match(text, after)
    if match:
        code = match[1].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return match.span(1)
    match = _NUMBER.match(text, after)
    return match.span(1) if match else None
