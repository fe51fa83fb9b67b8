"""Terms and digest-pin ledgers: append-only tables, decisions taken by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import is_iso8601
from tessella.session import broadcast_if_small, union_all

TERMS_SCHEMA = (
    "dataset string, terms_url string, terms_acceptance_token string, terms_sha256 string, "
    "accepted_at_iso string"
)
PINS_SCHEMA = (
    "dataset string, archive string, sha256 string, prior string, reason string, seq bigint"
)
PIN_KEY = ["dataset", "archive"]


def current_pins(ledger: DataFrame) -> DataFrame:
    """Latest entry per archive of the append-only pin ledger: ``(dataset, archive, sha256, seq, divergent)``.

    Where concurrent appends left different digests under the last number none of them is chosen: the archive is
    divergent and its digest null. Entries are reduced by number first, so an archive with a long history is not one
    task's work.
    """
    by_number = ledger.groupBy(*PIN_KEY, "seq").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"))
    last = by_number.groupBy(*PIN_KEY).agg(
        F.max_by(F.struct("low", "high"), "seq").alias("held"), F.max("seq").alias("seq")
    )
    divergent = ~F.col("held.low").eqNullSafe(F.col("held.high"))
    digest = F.when(~divergent, F.col("held.low"))
    return last.select(*PIN_KEY, digest.alias("sha256"), "seq", divergent.alias("divergent"))


def chain_problems(ledger: DataFrame) -> DataFrame:
    """Breaks of the chains of a pin ledger: ``(dataset, archive, seq, rule, detail)``.

    An archive's entries are numbered from 0 without gaps, each number once, and every entry's ``prior`` is the digest
    of the entry before it. Found are repeated entries, forks (different entries under one number, as concurrent
    appends leave them), gaps, priors that no entry before has, first entries with a prior, later ones without a
    reason, and numbers that are null or negative. An entry meets its predecessor by a join on the number, so a
    hot archive is spread over tasks by its numbers.
    """
    columns = [*PIN_KEY, "seq", "sha256", "prior", "reason"]
    entries = ledger.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    numbered = entries.filter("seq >= 0")
    at = numbered.groupBy(*PIN_KEY, "seq").agg(F.count(F.lit(1)).alias("entries"))

    def found(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
        return rows.select(*PIN_KEY, "seq", F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail"))

    before = [*PIN_KEY, (F.col("seq") + 1).alias("seq")]
    follows = at.select(*before)
    digests = numbered.select(*before, F.col("sha256").alias("prior")).distinct()
    later = numbered.filter("seq > 0")
    linked = later.join(follows, [*PIN_KEY, "seq"], "left_semi")
    unlinked = linked.join(digests, [*PIN_KEY, "seq", "prior"], "left_anti")
    blank = F.trim(F.coalesce("reason", F.lit(""))) == ""
    return union_all(
        [
            found(entries.filter("copies > 1"), "repeated_entry", F.col("copies").cast("string")),
            found(at.filter("entries > 1"), "fork", F.col("entries").cast("string")),
            found(at.filter("seq > 0").join(follows, [*PIN_KEY, "seq"], "left_anti"), "gap", F.lit("")),
            found(unlinked, "broken_prior", F.col("prior")),
            found(numbered.filter("seq = 0 AND prior IS NOT NULL"), "first_with_prior", F.col("prior")),
            found(later.filter(blank), "no_reason", F.col("sha256")),
            found(entries.filter("seq IS NULL OR seq < 0"), "bad_number", F.col("sha256")),
        ]
    )


def rotation_log(ledger: DataFrame) -> DataFrame:
    changed = ledger.filter(F.col("reason").isNotNull())
    return changed.select("archive", F.col("prior").alias("from"), F.col("sha256").alias("to"), "reason")


def _divergence(pins: DataFrame) -> Column:
    """The flag of :func:`current_pins`; plain tables of pins have none."""
    return (F.col("divergent") if "divergent" in pins.columns else F.lit(False)).alias("divergent")


def judge_terms(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Acceptance requests ``(dataset, token, terms_sha256, accepted_at_iso)`` with a ``status``.

    Dataset names match without regard to case; the token must equal the registered one.
    """
    # Many requests name few datasets, so the registry travels and the requests stay where they are.
    known = broadcast_if_small(
        registry.select(F.lower("dataset").alias("dataset"), "terms_url", "terms_acceptance_token")
    )
    asked = requests.withColumn("dataset", F.lower("dataset"))
    status = (
        F.when(F.col("terms_acceptance_token").isNull(), "unknown_dataset")
        .when(~F.col("token").eqNullSafe(F.col("terms_acceptance_token")), "wrong_token")
        .when(F.col("terms_sha256").isNull(), "missing_terms")
        .when(~is_iso8601(F.col("accepted_at_iso")), "bad_timestamp")
        .otherwise("accepted")
    )
    return asked.join(known, "dataset", "left").withColumn("status", status)


def judge_archive_names(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """Flag archive names the registry table ``(dataset, archive)`` does not list."""
    official = archives.select(*PIN_KEY).distinct().withColumn("official", F.lit(True))
    return requests.join(official, PIN_KEY, "left").withColumn(
        "official", F.coalesce("official", F.lit(False))
    )


def pin_actions(
    incoming: DataFrame, pins: DataFrame, acceptances: DataFrame | None = None
) -> DataFrame:
    """Create-only merge of ``(dataset, archive, sha256)``: insert, same, conflict or refused.

    Two different digests for one archive within the batch are a conflict as well, and so is an archive whose pins
    diverge. Without
    recorded terms for the dataset the request is refused (pass ``None`` to skip that rule).
    """
    batch = incoming.groupBy(*PIN_KEY).agg(
        F.min("sha256").alias("sha256"), F.max("sha256").alias("other")
    )
    held = pins.select(*PIN_KEY, F.col("sha256").alias("pinned"), _divergence(pins))
    joined = batch.join(held, PIN_KEY, "left")
    if acceptances is None:
        joined = joined.withColumn("accepted", F.lit(True))
    else:
        terms = broadcast_if_small(acceptances.select("dataset").distinct().withColumn("accepted", F.lit(True)))
        joined = joined.join(terms, "dataset", "left")
    action = (
        F.when(F.col("accepted").isNull(), "refused")
        .when((F.col("sha256") != F.col("other")) | F.coalesce("divergent", F.lit(False)), "conflict")
        .when(F.col("pinned").isNull(), "insert")
        .when(F.col("pinned") == F.col("sha256"), "same")
        .otherwise("conflict")
    )
    return joined.select(*PIN_KEY, "sha256", "pinned", action.alias("action"))


def rotation_entries(changes: DataFrame, pins: DataFrame) -> DataFrame:
    """Ledger entries replacing pins: ``changes`` is ``(dataset, archive, sha256, reason)``.

    A blank reason, an archive with more than one change in the batch (they have no order), and an archive whose
    pins diverge fail the job.
    """
    reason = F.trim(F.coalesce("reason", F.lit("")))
    checked = F.when(reason == "", F.raise_error(F.lit("rotation requires a reason"))).otherwise(
        F.col("reason")
    )
    once = changes.groupBy(*PIN_KEY).agg(
        F.count(F.lit(1)).alias("changes"), F.min("sha256").alias("sha256"), F.min(checked).alias("reason")
    )
    named = F.concat_ws("/", *PIN_KEY)
    digest = F.when(F.col("changes") > 1, F.raise_error(F.concat(F.lit("more than one change of "), named))).otherwise(F.col("sha256"))
    held = pins.select(*PIN_KEY, F.col("sha256").alias("prior"), F.col("seq").alias("held_seq"), _divergence(pins))
    settled = F.when(F.col("divergent"), F.raise_error(F.concat(F.lit("divergent pins of "), named))).otherwise(F.col("prior"))
    joined = once.withColumn("sha256", digest).join(held, PIN_KEY, "left").withColumn("prior", settled)
    seq: Column = F.coalesce("held_seq", F.lit(-1)) + 1
    return joined.select(*PIN_KEY, "sha256", "prior", "reason", seq.cast("bigint").alias("seq"))


def verify_pins(observed: DataFrame, pins: DataFrame) -> DataFrame:
    """Observed ``(dataset, archive, sha256)`` with status ok, mismatch, unpinned or divergent."""
    held = pins.select(*PIN_KEY, F.col("sha256").alias("pinned"), _divergence(pins))
    status = (
        F.when(F.col("divergent"), "divergent")
        .when(F.col("pinned").isNull(), "unpinned")
        .when(F.col("pinned") == F.col("sha256"), "ok")
        .otherwise("mismatch")
    )
    return observed.join(held, PIN_KEY, "left").select(
        *PIN_KEY, "sha256", "pinned", status.alias("status")
    )
