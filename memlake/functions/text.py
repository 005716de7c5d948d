"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and underscore; null gives none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9_]+"), "")


def recall_tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9 of three characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets in arrays; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def nfc(text: Column) -> Column:
    """Unicode composition, which Spark has no function for."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    return of(text)


def canonical_key(raw: Column) -> Column:
    """Composed, lower-cased, trimmed, white space runs as one space; blank gives null."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(nfc(raw)), r"(?U)\s+", " ")), F.lit(""))


#: Phrases by which stored text tries to steer whoever reads it.
CUES = [
    r"\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|prior|above|earlier)\b",
    r"\bsystem\s+prompt\b",
    r"\byou\s+are\s+now\b",
    r"\bnew\s+instructions?\b",
    r"\b(?:assistant|system|developer)\s*:",
    r"\bact\s+as\b",
    r"\bdo\s+not\s+(?:tell|reveal|mention)\b",
]


def flagged(text: Column) -> Column:
    """Whether any cue occurs, whatever its case."""
    out = F.lit(False)
    for cue in CUES:
        out = out | F.coalesce(text, F.lit("")).rlike("(?i)" + cue)
    return out


def sanitized(text: Column) -> Column:
    """Control characters but tab and line ends go, fences and the first hit of each cue get a zero-width space."""
    zero = "​"
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, "(<{3}|>{3}|`{3})", f"$1{zero}")
    for cue in CUES:
        out = F.regexp_replace(out, rf"(?is)\A(.*?)(?={cue})(\w)", f"$1$2{zero}")
    return F.trim(out)


def sentences(text: Column) -> Column:
    """Split after full stops; blanks dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=\.)\s+"), lambda s: F.trim(s)), lambda s: s != "")


def clipped(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n), F.lit("…")))
