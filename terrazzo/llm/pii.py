"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes, identifier cues
and street words. A local parser at each anchor expands to the entity's boundaries and validates it. The
base kinds (email, ip, card, phone) equal a leftmost non-overlapping search of their patterns over the
whole text; the others are added beside them and never change them.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret", "address")

# The cue words that start an identifier, a secret or a street address, and URL schemes.
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "akia")
STREET_WORDS = (" street", " avenue", " road", " lane", " boulevard", " drive")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL_REST = re.compile(r"[^\s<>\"'|\\^`{}]++")
# White space is taken possessively, so a run of it is read a bounded number of times.
_ACCOUNT = re.compile(r"(?:\s*+(?:no\.?|number|nr\.?|#))?\s*+[:=#]?\s*+([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})")
_SECRET = re.compile(r"\s*+[:=]\s*+[\"']?([^\s\"',;]{6,}+)")
_AKIA = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}(?: [A-Z][a-z]{1,20}){1,3}$")
#: Characters of the longest head of an address: five digits and three names of 21 letters with the spaces before them.
_HEAD = 5 + 3 * 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(value: str) -> bool:
    """Whether `value` is an IBAN by its check digits."""
    v = re.sub("[ -]", "", value).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", v):
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


@cache
def automaton() -> ahocorasick.Automaton:
    words: dict[str, tuple[str, int]] = {"@": ("@", 1), "+": ("+", 1)} | {str(d): ("digit", 1) for d in range(10)}
    for tag, cues in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES), ("street", STREET_WORDS)):
        for cue in cues:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                words[form] = (tag, len(form))
    out = ahocorasick.Automaton()
    for w, v in words.items():
        out.add_word(w, v)
    out.make_automaton()
    return out


def _part(x: str) -> bool:
    x = x.lstrip("0")
    return len(x) < 3 or len(x) == 3 and x <= "255"


def _ips(text: str, at: int, end: int) -> list[tuple[str, int, int]]:
    """The addresses of a run of digits and dots: of each stretch of numbers with one dot between, every four in turn."""
    out: list[tuple[str, int, int]] = []
    four: list[tuple[int, str]] = []
    for part in text[at:end].split("."):
        if part:
            four.append((at, part))
            if len(four) == 4:
                if all(_part(x) for _, x in four):
                    out.append(("ip", four[0][0], at + len(part)))
                four = []
        else:
            four = []
        at += len(part) + 1
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every entity, ends exclusive, by start, then kind in KINDS' order.

    URLs and secrets don't overlap others of their kind: a cue inside one starts none. So each parser reads a
    character a bounded number of times, and time is in proportion to the text.
    """
    found: list[tuple[str, int, int]] = []
    if not text:
        return found
    email_end = run_end = chain_end = 0
    ends = dict.fromkeys(("scheme", "secret"), 0)
    for last, (tag, n) in automaton().iter(text):
        at = last - n + 1
        if tag == "digit":
            if at >= chain_end:
                chain_end = _CHAIN.match(text, at).end()
                if chain_end - at >= 12:
                    digits = text[at:chain_end].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append(("card", at, chain_end))
            if at >= run_end:
                run_end = _IP_RUN.match(text, at).end()
                if run_end - at >= 7:
                    found += _ips(text, at, run_end)
        elif tag == "@":
            i = at
            while i > email_end and text[i - 1] in _LOCAL:
                i -= 1
            if i < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                found.append(("email", i, email_end))
        elif tag == "+":
            if (m := _PHONE.match(text, at)) and 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
        elif at >= ends.get(tag, 0):
            new = _added(text, tag, at, last + 1)
            if tag in ends:
                ends[tag] = max([0, *(b for _, _, b in new)])
            found += new
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda x: (x[1], order[x[0]], x[2]))


def _added(text: str, tag: str, at: int, end: int) -> list[tuple[str, int, int]]:
    """The entity beyond the base kinds whose anchor is text[at:end], if it validates."""
    if tag == "scheme":
        if (at == 0 or not text[at - 1].isalnum()) and (m := _URL_REST.match(text, end)):
            stop = end + len(m[0].rstrip(".,;:!?)"))
            return [("url", at, stop)] if stop - end >= 3 else []
    elif tag == "street":
        head = _HOUSE.search(text, max(0, at - _HEAD), at)
        if head and (end == len(text) or not text[end].isalnum()):
            return [("address", head.start(), end)]
    elif tag == "secret":
        if text[at:end] == "AKIA":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _AKIA.match(text, end)):
                return [("secret", at, m.end())]
        elif m := _SECRET.match(text, end):
            return [("secret", *m.span(1))]
    elif (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, end)):
        value = m[1]
        if text[at:end].lower() == "iban":
            words = value.split(" ")
            for n in range(len(words), 0, -1):
                if iban(short := " ".join(words[:n])):
                    return [("account", m.start(1), m.start(1) + len(short))]
        else:
            value = re.match(r"[A-Za-z0-9-]*", value)[0].rstrip("-")
            if sum(c.isdigit() for c in value) >= 6:
                return [("account", m.start(1), m.start(1) + len(value))]
    return []


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None) -> str | None:
    """The text with each maximal run of overlapping entities replaced by the first one's kind, as <EMAIL>."""
    if not text:
        return text
    out, end, kept = [], 0, 0
    for kind, a, b in find(text):
        if a >= end:
            out += [text[kept:a], f"<{kind.upper()}>"]
        end = kept = max(end, b)
    return "".join([*out, text[kept:]])


def digest(doc_id: int | None, text: str | None) -> tuple:
    spans = find(text)
    base = [x for x in spans if x[0] in BASE_KINDS]
    counts = [sum(x[0] == k for x in base) for k in BASE_KINDS]
    return (doc_id, *counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans))


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    A null or empty text has no entities: zeros, the digest of the empty list and "". A null doc_id stays
    null; repeated rows each give a row; an empty table gives none; other columns are ignored. A very long text is read whole, in time and
    memory in proportion to it. Map-only.
    """
    return map_rows(docs, digest, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", ["doc_id", "text"])


def redact_pii(docs: DataFrame) -> DataFrame:
    """`docs` with entities in `text` replaced and n_chars (where there is one) brought up to date.

    All other columns pass through unchanged, whatever they are called; null stays null, an empty text empty; repeated rows are redacted
    alike; an empty table gives none; very long texts as in find_pii(). Map-only.
    """
    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(redact, na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
