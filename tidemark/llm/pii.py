r"""Personal data with offset-preserving deobfuscation.

Plain identifiers are found in the text itself (the base).  Disguised ones are found in a normalised
copy made by three transducers in a row:

1. *homoglyphs*: look-alike and full-width characters become the ASCII ones they imitate;
2. *spelled digits*: runs of number words (``four one one ...``, ``plus`` before them) become digits;
3. *at and dot*: ``(at)``, ``[dot]`` and, between words that form an address, plain ``at`` and
   ``dot`` become ``@`` and ``.``.

A transducer yields edits ``(start, end, replacement)``; :class:`Mapped` applies them and keeps the
source span of every piece, so that a match in the normalised text maps back to source characters
through all stages.  A match counts where an edit lies in it; a match that no edit touches is a
base match already.  Base spans always stay; an added span never overlaps another of its kind.

Defined results.  A null text counts as empty.  Spans are code points, end exclusive.  Repeated rows
give repeated results; an empty table gives an empty table.  Only id and text are read, and any id
type passes through.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, batches, rows

KINDS = ("email", "ip", "card", "phone")

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")  # as [0-9]+(\.[0-9]+){3}, in linear time
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _ip(match: str) -> bool:
    parts = (p.lstrip("0") for p in match.split("."))  # a number of any length is read without its zeros
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in parts)


def _card(match: str) -> bool:
    digits = _NOT_DIGIT.sub("", match)
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(match: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", match)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """What :data:`_EMAIL` finds, leftmost and without overlap, looked for around each ``@``."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def plain(text: str) -> list[tuple[int, int, str]]:
    """Base matches as ``(start, kind's number, end)`` in the order of their kinds."""
    out = [(s, 0, e) for s, e in emails(text)]
    for k, pattern, good in ((1, _IP, _ip), (2, _CARD, _card), (3, _PHONE, _phone)):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if good(m[0])]
    return out


# Characters that look like an ASCII letter, digit or sign in some script.
_LOOK = {
    "АВЕКМНОРСТХаеорсухіјѕԁһ": "ABEKMHOPCTXaeopcyxijsdh",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοιν": "ABEZHIKMNOPTYXoiv",
    "․。．·∙•‧": ".......",
    "﹫＠": "@@",
    "‐‑‒–—−﹣－": "--------",
    "﹢＋": "++",
    "             　": " " * 14,
}


def _glyphs() -> dict[str, str]:
    """The look-alikes above, full-width forms, and decimal digits of every script, by rule."""
    import unicodedata

    out = {c: a for those, ascii_ in _LOOK.items() for c, a in zip(those, ascii_, strict=True)}
    out |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    for c in range(0x80, 0x1FBFA):
        if unicodedata.category(chr(c)) == "Nd":
            out[chr(c)] = str(unicodedata.decimal(chr(c)))
    for c in [*range(0x1D400, 0x1D6A4), *range(0x2460, 0x2469), *range(0x2070, 0x208A)]:
        plain_ = unicodedata.normalize("NFKC", chr(c))
        if len(plain_) == 1 and plain_.isascii() and plain_.isalnum():
            out.setdefault(chr(c), plain_)
    return out


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(re.escape(c) for c in sorted(GLYPHS)) + "]+")
# Zero-width characters inside an identifier are dropped.
_ZEROS = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_ODD = frozenset(GLYPHS) | frozenset(_ZEROS)
_ZERO = re.compile(f"[{_ZEROS}]+")

# English number words and the digits they spell.
_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4",
    "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}
_ANY = "(?:" + "|".join(_WORDS) + ")"
#: A run of three spelled digits or more, single digits allowed between, "plus" before.
_RUN = re.compile(rf"(?:\bplus[\s,.-]+)?\b{_ANY}(?:[\s,-]+(?:{_ANY}|[0-9]+|dot|point)\b){{2,}}", re.IGNORECASE)
_ITEM = re.compile(r"[A-Za-z]+|[0-9]+")

_BRACKET = re.compile(
    r"\s{0,8}[(\[{<]\s{0,8}(at|@|dot|\.|punkt|point|arroba)\s{0,8}[)\]}>]\s{0,8}", re.IGNORECASE
)
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]{0,62}[A-Za-z0-9])?"
#: name at host dot tld, with plain words or real signs mixed.
# Endings that make spoken words an address.
_ENDS = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|dev|app|eu|uk|us|ca|au|nz|ie|in|de|at|ch|fr|be|nl|es|pt|mx|ar|br|it|pl|se|no|dk|fi|ru|jp|cn|kr"
_DOT = r"(?:\.|\s{1,8}dot\s{1,8})"
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9]){_LABEL}(?:{_DOT}{_LABEL}){{0,3}}(?:\s{{1,8}}at\s{{1,8}}|\s{{0,8}}@\s{{0,8}}){_LABEL}(?:{_DOT}{_LABEL}){{0,3}}{_DOT}(?:{_ENDS})(?![A-Za-z0-9])",
    re.IGNORECASE,
)
_SIGN = re.compile(r"\s+(at|dot)\s+|\s*@\s*", re.IGNORECASE)
_STOP = r"(?:\s{0,8}\.\s{0,8}|\s{1,8}(?:dot|point)\s{1,8})"
_DOTTED = re.compile(
    rf"(?<![0-9.])[0-9]{{1,3}}{_STOP}(?:[0-9]{{1,3}}{_STOP}){{2}}[0-9]{{1,3}}(?![0-9])", re.IGNORECASE
)
# What a text must hold for the two patterns to call for an edit.
_HAS_AT = re.compile(r"@|\sat\s", re.IGNORECASE)
_HAS_JOINT = re.compile(r"\.\s|\s\.|\s(?:dot|point)\s", re.IGNORECASE)
_JOINT = re.compile(r"\s+(?:dot|point)\s+|\s*\.\s*", re.IGNORECASE)


class Mapped:
    """A text with edits applied: pieces know their source, through any number of stages."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts, self.source, self.edited = [0], [(0, len(text))], [False]

    def apply(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace ``text[start:end]`` for sorted edits without overlap."""
        if not edits:
            return
        out, starts, source, edited, at = [], [], [], [], 0
        length = 0

        def keep(lo: int, hi: int) -> None:
            nonlocal length
            while lo < hi:
                k = bisect_right(self.starts, lo) - 1
                stop = min(hi, self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text))
                out.append(self.text[lo:stop])
                starts.append(length)
                if self.edited[k]:
                    source.append(self.source[k])
                else:
                    shift = self.source[k][0] - self.starts[k]
                    source.append((lo + shift, stop + shift))
                edited.append(self.edited[k])
                length += stop - lo
                lo = stop

        for start, end, new in edits:
            keep(at, start)
            if new:
                out.append(new)
                starts.append(length)
                source.append(self.back(start, end))
                edited.append(True)
                length += len(new)
            at = end
        keep(at, len(self.text))
        self.text, self.starts, self.source, self.edited = "".join(out), starts or [0], source or [(0, 0)], edited or [False]

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source span of ``text[start:end]``."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        lo = self.source[i][0] + (0 if self.edited[i] else start - self.starts[i])
        hi = self.source[j][1] if self.edited[j] else self.source[j][0] + end - self.starts[j]
        return lo, hi

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit, or a deletion, lies in ``text[start:end]``."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        if any(self.edited[i : j + 1]):
            return True
        return any(self.source[k][1] != self.source[k + 1][0] for k in range(i, j))


def glyph_edits(text: str) -> list[tuple[int, int, str]]:
    if text.isascii() or _ODD.isdisjoint(text):
        return []
    out = [(m.start(), m.end(), "") for m in _ZERO.finditer(text)]
    for m in _GLYPH.finditer(text):
        out += [(i, i + 1, GLYPHS[text[i]]) for i in range(m.start(), m.end())]
    return sorted(out)


def digit_edits(text: str) -> list[tuple[int, int, str]]:
    low = text.lower()
    if not any(w in low for w in _WORDS):
        return []
    out = []
    for m in _RUN.finditer(text):
        made = []
        for item in _ITEM.finditer(m[0]):
            word = item[0].lower()
            made.append({"plus": "+", "dot": ".", "point": "."}.get(word) or _WORDS.get(word) or word)
        out.append((m.start(), m.end(), "".join(made)))
    return out


def sign_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    if any(c in text for c in "([{<"):
        for m in _BRACKET.finditer(text):
            out.append((m.start(), m.end(), "@" if m[1].lower() in ("at", "@", "arroba") else "."))
    starts, ends = [s for s, _, _ in out], [e for _, e, _ in out]

    def free(lo: int, hi: int) -> bool:
        k = bisect_left(starts, hi)  # the last one that begins before the end
        return not k or ends[k - 1] <= lo

    if _HAS_AT.search(text):
        for m in _SPOKEN.finditer(text):
            for sign in _SIGN.finditer(text, m.start(), m.end()):
                word = (sign[1] or "at").lower()
                if sign[0] != "@" and free(sign.start(), sign.end()):
                    out.append((sign.start(), sign.end(), "@" if word == "at" else "."))
    if _HAS_JOINT.search(text):
        for m in _DOTTED.finditer(text):
            for sign in _JOINT.finditer(text, m.start(), m.end()):
                if sign[0] != "." and free(sign.start(), sign.end()):
                    out.append((sign.start(), sign.end(), "."))
    out.sort()
    return [e for k, e in enumerate(out) if not k or e[0] >= out[k - 1][1]]


STAGES = (glyph_edits, digit_edits, sign_edits)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each sorted ``(start, kind's number, end)``."""
    text = text or ""
    base = sorted(plain(text))
    mapped = Mapped(text)
    for stage in STAGES:
        mapped.apply(stage(mapped.text))
    if not any(mapped.edited) and len(mapped.starts) == 1:
        return base, base
    found = list(base)
    starts = [[s for s, k, _ in base if k == kind] for kind in range(len(KINDS))]
    ends = [[e for _, k, e in base if k == kind] for kind in range(len(KINDS))]
    last = [0] * len(KINDS)  # where the last added span of each kind ends; they come in order
    for start, kind, end in sorted(plain(mapped.text)):
        if mapped.touched(start, end):
            lo, hi = mapped.back(start, end)
            k = bisect_left(starts[kind], hi)
            if lo >= last[kind] and (not k or ends[kind][k - 1] <= lo):
                found.append((lo, kind, hi))
                last[kind] = hi
    return base, sorted(found)



def _detect(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
    for part in parts:
        schema = pa.schema([("id", part.schema.field(0).type), ("spans", pa.list_(span))])

        def records(part=part) -> Iterator[tuple]:
            for ident, text in rows([part]):
                base, every = find(text)
                own = set(base)
                yield ident, [{"kind": KINDS[k], "start": s, "end": e, "base": (s, k, e) in own} for s, k, e in every]

        yield from batches(records(), schema)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, spans``: per row the sorted ``array<struct<kind, start, end, base>>``."""
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    out = arrow_map(own, _detect, f"id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
    return out.withColumnRenamed("id", id_col)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    got = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    tell = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    # The counts are of base spans; what the method adds is counted by itself.
    count = lambda k: F.size(F.filter("spans", lambda s: (s["kind"] == k) & s["base"])).cast("long").alias(f"n_{k}")
    return got.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(tell(F.filter("spans", lambda s: s["base"])).cast("binary"), 256).alias("base_sha256"),
        tell(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )
