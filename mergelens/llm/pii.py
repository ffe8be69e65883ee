"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Each kind has a pattern, a validity check, a base score and words that make it more
likely when they stand near. A span is reported if it passes its check and its score
reaches the threshold. Email, ip, card and phone are reported whenever their check
passes (card: Luhn); further kinds are iban (mod-97), ssn and secret, of which the last two need a context
word. Positions are code points of the whole text, the end exclusive; spans of
different kinds may overlap.

Null text has no spans, like empty text; a null id, repeated rows and extra columns
stay as they are. Patterns take time linear in the text, however long its runs of
digits or letters are, and memory is a text and its spans. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
THRESHOLD = 0.5
CONTEXT_CHARS = 48

# Base score, gain by a checksum, gain by a context word near the span.
SCORES = {
    "email": (0.9, 0.0, 0.1),
    "ip": (0.6, 0.0, 0.3),
    "card": (0.5, 0.3, 0.2),
    "phone": (0.6, 0.0, 0.3),
    "iban": (0.3, 0.5, 0.2),
    "ssn": (0.3, 0.0, 0.5),
    "secret": (0.2, 0.0, 0.6),
}
CONTEXT = {
    "email": ("email", "e-mail", "mail", "correo", "courriel", "contact"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "credit", "visa", "mastercard", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "bearer"),
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])")
_WORDS = {
    kind: re.compile("(?<![^\\W\\d_])(?:" + "|".join(map(re.escape, words)) + ")(?![^\\W\\d_])", re.IGNORECASE)
    for kind, words in CONTEXT.items()
}

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether a digit string passes the Luhn check."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(compact: str) -> bool:
    """Whether an account number passes the mod-97 check."""
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """Local part, at sign, domain with a dot; found from the at sign, so long runs cost nothing."""
    last = 0
    for match in _DOMAIN.finditer(text):
        start = at = match.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            last = match.end()
            yield start, last


def ips(text: str) -> Iterator[Span]:
    """Four numbers of at most 255."""
    for match in _IP.finditer(text):
        parts = [part.lstrip("0") for part in match[0].split(".")]
        if all(len(part) < 3 or (len(part) == 3 and part <= "255") for part in parts):
            yield match.span()


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def cards(text: str) -> Iterator[Span]:
    """12 to 19 digits that pass the Luhn check."""
    for match in _CARD.finditer(text):
        if 12 <= match.end() - match.start() <= 37:
            digits = _digits(match[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def phones(text: str) -> Iterator[Span]:
    """An international number of 9 to 15 digits."""
    for match in _PHONE.finditer(text):
        if 9 <= len(_digits(match[0])) <= 15:
            yield match.span()


def ibans(text: str) -> Iterator[Span]:
    """15 to 34 letters and digits that pass the mod-97 check, ending where a group ends."""
    for match in _IBAN.finditer(text):
        found = match[0]
        while len(found) >= 15:
            compact = found.replace(" ", "")
            if 15 <= len(compact) <= 34 and mod97(compact):
                yield match.start(), match.start() + len(found)
                break
            found = found.rpartition(" ")[0]


def ssns(text: str) -> Iterator[Span]:
    """Three, two and four digits in ranges that are given out."""
    for match in _SSN.finditer(text):
        area, group, serial = match.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield match.span()


def secrets(text: str) -> Iterator[Span]:
    """Hexadecimal runs with both letters and digits."""
    for match in _SECRET.finditer(text):
        if not match[0].isdigit() and not match[0].isalpha():
            yield match.span()


# A kind's proposals and a string without which a text has none of them.
_PROPOSALS = (
    ("email", emails, "@"),
    ("ip", ips, "."),
    ("card", cards, ""),
    ("phone", phones, "+"),
    ("iban", ibans, ""),
    ("ssn", ssns, "-"),
    ("secret", secrets, ""),
)


def score(kind: str, text: str, start: int, end: int) -> float:
    """Base score, what a checksum adds, and what a context word before or after the span adds."""
    base, checked, near = SCORES[kind]
    around = text[max(0, start - CONTEXT_CHARS) : start] + "\n" + text[end : end + CONTEXT_CHARS // 2]
    return round(base + checked + (near if _WORDS[kind].search(around) else 0.0), 6)


def text_spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of a text, by start, then kind as listed."""
    found = []
    for order, (kind, propose, needs) in enumerate(_PROPOSALS):
        if text and needs in text:
            for start, end in propose(text):
                points = score(kind, text, start, end)
                if kind in BASE_KINDS or points >= threshold:
                    found.append((start, order, kind, end, points))
    return [(kind, start, end, points) for start, _, kind, end, points in sorted(found)]


_SPANS = T.ArrayType(
    T.StructType()
    .add("kind", T.StringType())
    .add("start", T.LongType())
    .add("end", T.LongType())
    .add("score", T.DoubleType())
)
_ARROW_SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def find_spans(
    docs: DataFrame, keep: Sequence[str | Column] = ("doc_id",), text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The columns ``keep`` of every row and ``spans``: kind, start, end and score by start, then kind.

    A kept column called ``spans`` is replaced.
    """
    kept = docs.select(F.struct(*keep).alias("kept"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "score")
        for batch in batches:
            rows = [[dict(zip(names, span)) for span in text_spans(t, threshold)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, _ARROW_SPANS)], ["kept", "spans"])

    row = kept.schema["kept"].dataType
    told = kept.mapInArrow(run, T.StructType().add("kept", row).add("spans", _SPANS))
    fields = [F.col("kept").getField(f.name).alias(f.name) for f in row if f.name != "spans"]
    return told.select(*fields, "spans")


def mask(text: str | Column, spans: str | Column = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap, the first in order is."""
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, span: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, (span["start"] - acc["at"]).cast("int"))
        done = F.struct(
            F.concat(acc["out"], gap, F.lit("["), F.upper(span["kind"]), F.lit("]")).alias("out"), span["end"].alias("at")
        )
        return F.when(span["start"] < acc["at"], acc).otherwise(done)

    return F.aggregate(
        spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text)))
    )
