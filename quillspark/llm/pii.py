"""Personal data: base patterns, and disguised ones through offset-preserving normalisation.

Base spans are leftmost, non-overlapping matches of each kind in the text itself.
Texts that may hold a disguise are normalised by two transducers, each of which
remembers for every output character the source characters that it stands for:
single code points first (full-width and styled forms, look-alike letters, digits of
any script, dashes; invisible characters vanish), then words (bracketed and spelled
``at`` and ``dot``, runs of spelled digits, ``plus``).  The same detectors run on the
result, and what they find is mapped back to source characters.  A span inside a base
span of its kind is the base span again; all others are added.

Offsets are code points, ends exclusive.  Defined cases: null counts as empty; no
finding gives counts of 0 and empty strings; candidates that fail their check (parts
over 255, Luhn, number of digits) are dropped, never shortened; repeated rows are
alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillspark.llm.codepoints import codes
from quillspark.llm.common import col, id_type

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like a Latin letter, and punctuation that looks like ASCII.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ғ": "f", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ո": "n", "ս": "u", "օ": "o", "հ": "h",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "·": ".", "∙": ".", "⋅": ".",
}
INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|arobase|klammeraffe", "dot|punkt|punto|point|period", "plus|más"

_digit = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_gap = rf"[\s,-]+(?:(?:{DOT_WORDS})[\s-]+)?"
_spelled = rf"(?:(?:{PLUS_WORDS}|\+)[\s-]*)?(?<!\w){_digit}(?:(?:{_gap}|\s*\.\s*)(?:{_digit}|[0-9]+)(?!\w)){{2,}}"
_lead = r"(?:(?<!\s)\s+)?"  # white space, looked at from its start alone
_at = rf"{_lead}[\[({{<]\s*(?:{AT_WORDS}|@)\s*[\])}}>]\s*"
_dot = rf"{_lead}[\[({{<]\s*(?:{DOT_WORDS}|\.)\s*[\])}}>]\s*"
_host = rf"[A-Za-z0-9-]+(?:\s+(?:{DOT_WORDS})\s+|{_dot})[A-Za-z0-9-]"  # enough of it to know one
_bare_at = rf"(?<=[A-Za-z0-9_%+-])\s+(?:{AT_WORDS})\s+(?={_host})"
_joined_at = r"(?<=[A-Za-z0-9])[_-]at[_-](?=[A-Za-z0-9-])"  # counts where a host stands behind it
_bare_dot = rf"(?<=[A-Za-z0-9-])\s+(?:{DOT_WORDS})\s+(?=[A-Za-z0-9-])"
REWRITE = re.compile(rf"(?P<spelled>{_spelled})|(?P<at>{_at}|{_bare_at})|(?P<joined>{_joined_at})|(?P<dot>{_dot}|{_bare_dot})", re.IGNORECASE)
#: Whole runs of a host's characters with a disguised dot behind them.
HOSTS = re.compile(rf"(?<![A-Za-z0-9-])[A-Za-z0-9-]++(?=(?:\s+(?:{DOT_WORDS})\s+|{_dot})[A-Za-z0-9-])", re.IGNORECASE)
_TOKEN = re.compile(rf"(?P<digit>{_digit}|[0-9]+)|(?P<dot>{DOT_WORDS}|\.)|(?P<plus>{PLUS_WORDS}|\+)", re.IGNORECASE)


def emails(text: str) -> list[tuple[int, int]]:
    """One look at every @: the local part is the run before it, which no other @ shares."""
    found, after, at = [], 0, text.find("@")
    while at >= 0:
        before = text[after:at]
        local = len(before) - len(before.rstrip(LOCAL))
        after = at + 1
        if local and (host := DOMAIN.match(text, at + 1)):
            found.append((at - local, host.end()))
            after = host.end()
        at = text.find("@", after)
    return found


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, in order of start."""
    found = {"email": emails(text)}
    found["ip"] = [m.span() for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    found["card"] = [m.span() for m in CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    found["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


@cache
def single_characters() -> np.ndarray:
    """By code point: the ASCII character that it stands for, 0 if it vanishes, else itself."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x80, 0x110000):
        ch = chr(c)
        plain = unicodedata.normalize("NFKC", ch) if not 0xD800 <= c < 0xE000 else ch
        if len(plain) == 1 and plain < "\x80":
            table[c] = ord(plain)
        elif (value := unicodedata.decimal(ch, None)) is not None:
            table[c] = 48 + value
    for ch, plain in LOOKALIKES.items():
        table[ord(ch)] = ord(plain)
    for ch in INVISIBLE:
        table[ord(ch)] = 0
    return table


def _class(points: list[int]) -> str:
    """The inside of an RE2 character class of these code points, in order."""
    cuts = np.flatnonzero(np.diff(points) > 1) + 1
    return "".join(rf"\x{{{run[0]:X}}}-\x{{{run[-1]:X}}}" for run in np.split(np.array(points), cuts))


@cache
def trigger() -> str:
    """What a text must hold to be normalised: a character that the first transducer changes, or what the second one may rewrite.

    Run by RE2 over whole batches, so it has no look-around; and as RE2's own is of ASCII only, Python's white space is spelled out.
    """
    table = single_characters()
    changed = _class(np.flatnonzero((table != np.arange(table.size)) | (table == 0)).tolist())
    gap = _class([c for c in range(table.size) if chr(c).isspace()])
    s, d, dots = f"[{gap}]", "(?:" + "|".join(DIGITS) + ")", f"(?:{DOT_WORDS})"
    return rf"(?i:[\[({{<]{s}*(?:{AT_WORDS}|@|{DOT_WORDS}|\.){s}*[\])}}>]|{s}{dots}{s}|{d}(?:[{gap},.-]+(?:{dots}[{gap}-]+)?(?:{d}|[0-9]+)){{2}})|[{changed}]"


def rewrites(plain: str) -> Iterator[re.Match]:
    """The disguises of words, from left to right.

    Whether a host stands behind a joined ``at`` is known from one look at all hosts, as many may lie in one run.
    """
    hosts, k, at = None, 0, 0
    while m := REWRITE.search(plain, at):
        at = m.end()
        if m["joined"]:
            hosts = [h.span() for h in HOSTS.finditer(plain)] if hosts is None else hosts
            while k < len(hosts) and hosts[k][1] <= m.end():
                k += 1
            if k == len(hosts) or hosts[k][0] > m.end():
                at = m.start() + 1
                continue
        yield m


def normalise(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text without disguises, and for each of its characters the source start and end."""
    points = single_characters()[codes(text)]
    kept = np.flatnonzero(points)
    plain = points[kept].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out, starts, ends, last = [], [], [], 0

    def copy(a: int, b: int) -> None:
        out.append(plain[a:b])
        starts.append(kept[a:b])
        ends.append(kept[a:b] + 1)

    def put(chars: str, a: int, b: int) -> None:
        out.append(chars)
        starts.append(np.full(len(chars), kept[a]))
        ends.append(np.full(len(chars), kept[b - 1] + 1))

    for m in rewrites(plain):
        copy(last, m.start())
        last = m.end()
        if m["at"] is not None or m["joined"] is not None:
            put("@", m.start(), m.end())
        elif m["dot"] is not None:
            put(".", m.start(), m.end())
        else:
            for t in _TOKEN.finditer(plain, m.start(), m.end()):
                put(DIGITS.get(t[0].lower(), t[0]) if t["digit"] else "." if t["dot"] else "+", t.start(), t.end())
    copy(last, len(plain))
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def disguised(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans in source characters that only the normalised text shows."""
    plain, starts, ends = normalise(text)
    added: dict[str, list[tuple[int, int]]] = {}
    for kind, spans in detect(plain).items():
        known = [x for x, _ in base[kind]]
        for a, b in spans:
            s, e = int(starts[a]), int(ends[b - 1])
            k = bisect_right(known, s) - 1
            if k < 0 or base[kind][k][1] < e:
                added.setdefault(kind, []).append((s, e))
    return added


def joined(found: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(found.get(kind, ())))


def redact(text: str, spans: str, mask: str = "[{}]") -> str:
    """The text with every span of a ``spans`` string replaced by its kind; overlapping spans become one."""
    cuts = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s))
    out, last = [], 0
    for a, b, kind in cuts:
        if a >= last:
            out += [text[last:a], mask.format(kind)]
        last = max(last, b)
    return "".join(out) + text[last:]


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added."""
    nothing, odd_ones = hashlib.sha256(b"").hexdigest(), trigger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            some = pc.match_substring_regex(texts, "[0-9@]").to_pylist()
            odd = pc.match_substring_regex(texts, odd_ones).to_pylist()
            counts, hashes, spans, more = {k: [] for k in KINDS}, [], [], []
            for k in range(batch.num_rows):
                text = texts[k].as_py() if some[k] or odd[k] else ""
                base = detect(text) if some[k] else {kind: [] for kind in KINDS}
                added = disguised(text, base) if odd[k] else {}
                for kind in KINDS:
                    counts[kind].append(len(base[kind]))
                plain = joined(base)
                hashes.append(hashlib.sha256(plain.encode()).hexdigest() if plain else nothing)
                spans.append(joined({kind: base[kind] + added.get(kind, []) for kind in KINDS}) if added else plain)
                more.append(sum(map(len, added.values())))
            columns = [batch.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(hashes, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    schema = f"doc_id {id_type(docs, id_col)}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)
