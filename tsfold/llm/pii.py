"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over a text and reports anchors: at-signs,
plus signs before a digit, digits that a digit or a full stop follows, schemes
of addresses and cues of identifiers. At each anchor a small parser finds the
bounds of the value around it and checks it. Base kinds give exactly the
leftmost non-overlapping matches of their patterns:

* ``email`` expands to both sides of an at-sign,
* ``ip`` goes back to the start of the digits and takes four groups, each at most 255,
* ``card`` takes digits with single spaces or hyphens: 13 to 19 digits, Luhn sum,
* ``phone`` starts at a plus sign: 9 to 15 digits.

A match that fails its check is dropped and the search goes on behind it.
Further kinds: ``url`` (an address behind its scheme), ``iban`` (country code,
check digits, the country's length, remainder 1 of 97; wherever it stands),
``secret`` (the value behind a cue such as ``password=`` or ``"password":``, up to
its closing quote or white space, and access key ids), ``phone_within`` (the longest part of a rejected phone candidate,
from its start to a blank or bracket, that has 9 to 15 digits) and ``card_within`` (groups of 4-4-4-4 or 4-6-5 digits with
a right Luhn sum inside a rejected card candidate).

Edge cases: a null text counts as empty and has no spans; rows are kept as they
are (repeated or null ids); texts are scanned whole; positions are code points,
ends exclusive; only the id and text columns are read (``mask`` passes the others on).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsfold.llm.common import byte_slices, texts_of

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "secret", "phone_within", "card_within")
_D = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + _D + "._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+(?:\.[0-9]+){3}").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_url = re.compile(r"[^\s\"'<>\\^`{|}]+").match
_host = re.compile(r"(?:[^\s/@]*@)?(?:[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|localhost|\[[0-9A-Fa-f:]+\])").match
_value = re.compile(r"\\?[\"']?[ \t]*[=:][ \t]*(?:(\\?[\"'])((?:(?!\1)(?:\\.|[^\n\\])){6,})\1"
                    r"|\\?[\"']([^\s\"']{6,})(?!\S)|(?!\\?[\"'])(\S{6,}))").match
_key_id = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])").match

SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://")
CUES = ("password", "passwd", "secret", "api_key", "apikey", "api-key", "access_key", "token")
#: Length of an account number by country.
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE,BI 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,DZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:AO,CV,GW,LY,MZ,PT,ST 26:IR,IS,TR 27:BF,CF,CG,CM,DJ,FR,GA,GQ,GR,IT,KM,MC,MG,MR,SM,TD "
    "28:AL,AZ,BJ,BY,CI,CY,DO,GT,HN,HU,LB,MA,ML,NE,NI,PL,SN,SV,TG 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split())
    for c in cs.split(",")}


_UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _D)
_IBANS = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])").match for n in set(IBAN_LENGTHS.values())}


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


_groups = re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")


def _cards_within(text: str, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Card numbers in groups inside a rejected candidate."""
    at = start
    while m := _groups.search(text, at, stop):
        if _luhn(m.group().replace(" ", "").replace("-", "")):
            yield m.span()
            at = m.end()
        else:
            at = m.start() + 1


def _phone_within(text: str, start: int, stop: int) -> int:
    """End of the longest beginning of a rejected candidate that is a phone number, or 0."""
    digits = end = 0
    for i in range(start + 1, stop):
        if text[i] in _D:
            digits += 1
            if digits > 15:
                break
            if digits >= 9 and (i + 1 == stop or text[i + 1] in " ()"):
                end = i + 1
    return end


def _iban_ok(value: str) -> bool:
    s = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    """Anchors and the parser each calls for."""
    import ahocorasick

    a = ahocorasick.Automaton()
    words = {"@": "email"}
    words |= {"+" + d: "phone" for d in _D}
    words |= {d + ".": "ip" for d in _D}
    words |= {d + s + e: "card" for d in _D for s in ("", " ", "-") for e in _D}
    words |= {form: "url" for s in SCHEMES for form in (s, s.upper())}
    words |= {form: "secret" for c in CUES for form in (c, c.upper(), c.capitalize())}
    words |= {c + d: "iban" for c in IBAN_LENGTHS for d in _D} | {"AKIA": "key"}
    for w, kind in words.items():
        a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def find_spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(kind's number in ``KINDS``, start, end) of all spans, by kind, then start."""
    found: list[tuple[int, int, int]] = []
    end = [0] * len(KINDS)
    for last, (anchor, width) in anchors.iter(text):
        at = last + 1 - width
        if anchor == "card":
            if at < end[2]:
                continue
            m = _card(text, at)
            end[2] = m.end()
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, at, m.end()))
            elif len(digits) > 15:
                found.extend((8, a, b) for a, b in _cards_within(text, at, m.end()))
        elif anchor == "ip":
            if at < end[1]:
                continue
            while at > end[1] and text[at - 1] in _D:
                at -= 1
            m = _ip(text, at)
            if m:
                end[1] = m.end()
                if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".")):
                    found.append((1, at, m.end()))
        elif anchor == "email":
            start = at
            while start > end[0] and text[start - 1] in _LOCAL:
                start -= 1
            m = _domain(text, at + 1) if start < at else None
            if m:
                end[0] = m.end()
                found.append((0, start, m.end()))
        elif anchor == "phone":
            if at < end[3]:
                continue
            m = _phone(text, at)
            if m:
                end[3] = m.end()
                if 9 <= (n := sum(c in _D for c in m.group())) <= 15:
                    found.append((3, at, m.end()))
                elif n > 15 and (stop := _phone_within(text, at, m.end())):
                    found.append((7, at, stop))
        elif anchor == "url":
            if at < end[4] or at and text[at - 1].isalpha() or not _host(text, at + width):
                continue
            stop = _url(text, at).end()
            while text[stop - 1] in ".,;:!?)]":
                stop -= 1
            found.append((4, at, stop))
            end[4] = stop
        elif anchor == "iban":
            if at < end[5] or at and text[at - 1] in _UPPER and text[max(at - 4, 0):at] != "IBAN":
                continue
            m = _IBANS[IBAN_LENGTHS[text[at:at + 2]]](text, at)
            if m and _iban_ok(m.group()):
                found.append((5, at, m.end()))
                end[5] = m.end()
        else:
            if at + width < end[6]:
                continue
            m = _key_id(text, at) if anchor == "key" else _value(text, at + width)
            if m:
                start, stop = m.span() if anchor == "key" else m.span(m.lastindex)
                while text[stop - 1] == ".":
                    stop -= 1
                if start >= end[6] and stop - start >= 6:
                    found.append((6, start, stop))
                    end[6] = stop
    found.sort()
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: the number of spans of each base kind, the digest of the base spans, all spans and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in byte_slices(batch, "text"):
                counts, digests, joined, every = [], [], [], []
                for text in texts_of(part, "text"):
                    spans = find_spans(text, anchors)
                    base = [s for s in spans if s[0] < len(BASE)]
                    counts.append([sum(s[0] == k for s in base) for k in range(len(BASE))])
                    digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    joined.append(_joined(spans))
                    every.append(len(spans))
                yield pa.record_batch([part.column("id"), *(pa.array(c, pa.int64()) for c in zip(*counts)),
                                       pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(every, pa.int64())],
                                      names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_all"])

    narrow = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_all long"
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the kind of its first span in angle brackets."""
    out, at = [], 0
    for start, stop, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].removesuffix('_within')}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with all spans masked in its text; ``length_col``, if given, becomes the new length in characters.

    A null text stays null; all other columns stay as they are.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for batch in batches:
            for part in byte_slices(batch, text_col):
                texts = [x if x is None else masked(x, find_spans(x, anchors)) for x in part.column(text_col).to_pylist()]
                cols = {c: part.column(c) for c in part.schema.names}
                cols[text_col] = pa.array(texts, part.schema.field(text_col).type)
                if length_col:
                    cols[length_col] = pa.array([None if x is None else len(x) for x in texts], part.schema.field(length_col).type)
                yield pa.record_batch(list(cols.values()), names=list(cols))

    return df.mapInArrow(run, df.schema)
