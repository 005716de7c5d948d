"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; runs of anything but letters become one space; n-grams of 1 to 3 code points are
hashed into BUCKETS. Each task counts its grams by language, Spark adds the counts up, and the table of
log-probabilities (languages x BUCKETS floats, whatever the corpus) is broadcast. A batch of texts is scored as a
sparse product in numpy: the grams of all its texts in a row, one language's table at them, added up text by text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, short_batches, turn_to

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Added to every count.
SMOOTHING = 0.5
#: The most languages a model holds; more are an error, so the broadcast table stays below 64 MB.
MOST_LANGUAGES = 256
UNKNOWN = "und"

#: Characters of a long text that are worked on at once; grams over the joints are counted with the later part.
_PART = 1 << 18
#: Grams of a batch that are scored at once.
_GRAMS = 1 << 21
_CODE: np.ndarray | None = None


def _codes() -> np.ndarray:
    """Each code point itself if a letter, else a space."""
    global _CODE
    if _CODE is None:
        _CODE = np.fromiter((c if chr(c).isalpha() else 32 for c in range(0x110000)), np.uint32, 0x110000)
    return _CODE


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _hashes(c: np.ndarray, buckets: int, known: int = 0) -> np.ndarray:
    """The buckets of all n-grams of normalized codes, but for those within the first ``known`` codes."""
    h, out = c.copy(), []
    for order in ORDERS:
        if order > 1:
            h = h[:-1] * np.uint32(0x9E3779B1) + c[order - 1 :]
        new = h[max(0, known - order + 1) :]
        if len(new):
            mixed = (new ^ (new >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * order)
            out.append((mixed >> np.uint32(8)) % np.uint32(buckets))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _letters(low: str, after_space: bool) -> np.ndarray:
    """Codes of a lower-cased text; a run of anything but letters is one space, none if a space came before."""
    c = _codes()[np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = c == 32
    return c[~(space & np.concatenate(([after_space], space[:-1])))]


def gram_hashes(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every n-gram of a text that has a letter, in no particular order."""
    return _hashes(np.concatenate(([32], _letters(text.lower(), True), [32])).astype(np.uint32), buckets)


def gram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a text of any length; the same as of gram_hashes, in parts."""
    total, low = np.zeros(buckets, np.int64), text.lower()
    seen = np.empty(0, np.uint32)
    for at in range(0, len(low), _PART):
        first, last = at == 0, at + _PART >= len(low)
        new = _letters(low[at : at + _PART], first or seen[-1] == 32)
        codes = np.concatenate((seen, [32] * first, new, [32] * last)).astype(np.uint32)
        total += np.bincount(_hashes(codes, buckets, len(seen)), minlength=buckets)
        seen = codes[-(max(ORDERS) - 1) :]
    return total


class Model:
    """langs, and log-probabilities of the buckets (languages x buckets) and of the languages."""

    def __init__(self, langs: list[str], table: np.ndarray, prior: np.ndarray):
        self.langs, self.table, self.prior = langs, table.astype(np.float32), prior

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its probability; ``und`` and 0 without a letter or without languages."""
        out = [(UNKNOWN, 0.0)] * len(texts)
        held: list[np.ndarray] = []
        places: list[int] = []

        def score() -> None:
            if not held:
                return
            grams, starts = np.concatenate(held), np.cumsum([0, *map(len, held[:-1])])
            logs = np.stack([np.add.reduceat(t[grams], starts, dtype=np.float64) for t in self.table], axis=1)
            tell(places, logs)
            held.clear()
            places.clear()

        def tell(rows: list[int], logs: np.ndarray) -> None:
            logs = logs + self.prior
            best = np.argmax(logs, axis=1)
            p = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            for row, k, x in zip(rows, best.tolist(), p.tolist(), strict=True):
                out[row] = (self.langs[k], x)

        for row, text in enumerate(texts):
            if not self.langs or not has_letter(text):
                continue
            if len(text) > _PART:
                tell([row], (self.table.astype(np.float64) @ gram_counts(text))[None])
                continue
            held.append(gram_hashes(text))
            places.append(row)
            if sum(map(len, held)) > _GRAMS:
                score()
        score()
        return out


def fit(labelled: DataFrame) -> Model:
    """A model of the columns text and lang; rows in which either is null teach nothing.

    Every gram of every row counts. Languages are in the order of their names; with none, all is ``und``.
    """
    short_batches(labelled.sparkSession)

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            turn_to("langid")
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                rows[lang] = rows.get(lang, 0) + 1
                if has_letter(text):
                    if len(text) > _PART:
                        own += gram_counts(text)
                    else:
                        own += np.bincount(gram_hashes(text), minlength=BUCKETS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            n = len(at) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(own[at], rows[lang]), pa.int64())],
                ["lang", "bucket", "n"],
            )

    known = labelled.where("lang is not null and text is not null").select("text", F.col("lang").cast("string"))
    sums = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; at most {MOST_LANGUAGES}")
    table, rows = np.full((len(langs), BUCKETS), SMOOTHING), np.full(len(langs), 1.0)
    place = {lang: k for k, lang in enumerate(langs)}
    row = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    total = bucket < 0
    table[row[~total], bucket[~total]] += n[~total]
    rows[row[total]] += n[total]
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)), np.log(rows / rows.sum()) if langs else rows)


def identify(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct of lang_pred and score for a text column of ``docs``."""
    short_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def of(texts: pa.Array) -> pa.Array:
        turn_to("langid")
        got = sent.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["lang_pred", "score"]
        )

    return of(F.col(text))


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text-free, with lang_pred and score for every row: null and letterless texts are ``und`` with 0."""
    return docs.select("doc_id", identify(docs, model).alias("_p")).select("doc_id", "_p.lang_pred", "_p.score")


def op2_language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; held out are ids whose crc32 as text is 2 modulo 4."""
    model = fit(docs.where(id_bucket(F.col("doc_id"), 4) != 2).select("text", "lang"))
    scored = docs.select("doc_id", identify(docs, model).alias("p"))
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows whose language is told with a probability of ``least`` or more, columns unchanged.

    The model is fitted to the rows themselves. Null and letterless texts go.
    """
    model = fit(docs.select("text", "lang"))
    p = identify(docs, model)
    return docs.where((p["lang_pred"] != UNKNOWN) & (p["score"] >= least))
