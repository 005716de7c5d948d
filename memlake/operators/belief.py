"""Write-through beliefs: an ordered log of claims folded into verdicts, one subject at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step(content, importance, claim: dict) -> tuple[str, str | None, float | None]:
    """The verdict on one claim against the incumbent, and the belief held afterwards. Batch and stream share it.

    claim: content, importance (or None), require_evidence, supports_new.
    """
    given = 0.6 if claim["importance"] is None else claim["importance"]
    if content is None:
        if claim["require_evidence"] and not claim["supports_new"]:
            return "reject", None, None
        return "augment", claim["content"], given
    if content == claim["content"]:
        return "confirm", content, min(1.0, given + 0.1)
    if claim["supports_new"]:
        return "supersede", claim["content"], max(given, 0.9)
    return "reject", content, importance


def commit(claims: DataFrame) -> DataFrame:
    """subject, ord, verdict, held (the belief after it), importance for every claim.

    claims: subject, ord, content, importance, require_evidence, supports_new. Subjects are independent; the
    claims of one are sorted by ord in a spillable sort and folded in a stream, so a subject may have any number.
    """
    import pyarrow as pa

    def run(batches):
        now, first, held, weight = None, True, None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if first or row["subject"] != now:
                    now, first, held, weight = row["subject"], False, None, None
                verdict, held, weight = step(held, weight, row)
                out.append((now, row["ord"], verdict, held, weight))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["subject", "ord", "verdict", "held", "importance"])

    placed = claims.select("subject", "ord", "content", "importance", "require_evidence", "supports_new").repartition("subject")
    return placed.sortWithinPartitions("subject", "ord").mapInArrow(run, "subject string, ord long, verdict string, held string, importance double")


def commit_supported(claims: DataFrame) -> DataFrame:
    """The same where every claim is supported: each is compared with the one before, no Python."""
    before = F.lag("content").over(Window.partitionBy("subject").orderBy("ord"))
    verdict = F.when(before.isNull(), "augment").when(before == F.col("content"), "confirm").otherwise("supersede")
    return claims.select("subject", "ord", "content", verdict.alias("verdict"))


def supports(must: Column, absent: Column, listing: Column) -> Column:
    """Whether a listing has all that must exist and nothing that must be absent."""
    return (F.size(F.array_except(must, listing)) == 0) & (F.size(F.array_intersect(absent, listing)) == 0)


def claims_from_events(events: DataFrame) -> DataFrame:
    """A claim for each event: the subject is (user, type), the content the value in tens."""
    return events.select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("subject"),
        F.col("event_id").alias("ord"),
        F.floor(F.col("value") / 10).cast("long").cast("string").alias("content"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("importance"),
        F.lit(False).alias("require_evidence"),
        (F.col("event_id") % 3 != 0).alias("supports_new"),
    )
