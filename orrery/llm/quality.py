"""Quality rules as a ledger of bits: every rule is evaluated once, policies are bit masks.

``measure`` reads each whole text once and returns its measurements; ``ledger`` turns them into one bit per
failed rule; ``apply_policy`` keeps what a versioned mask lets through; ``ablation`` counts by bitwise
aggregation what each rule rejects, and what it alone rejects, without reading a text again.

Defined results: a null or empty text has no words and all measurements 0, so it fails ``too_short``; texts
of any length are read whole; repeated rows are judged one by one; an empty table gives an empty ledger;
further columns are kept by ``ledger`` (its own columns are named in ``MEASURES`` and ``rule_bits``; input
columns of those names are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits

#: Long measurements of a text.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_shouts", "n_stutters")
REPEAT = 8
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Rules in ledger order: bit i is set where rule i fails.
RULES: tuple[tuple[str, str], ...] = (
    ("too_short", "n_words < 20"),
    ("repeats", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)"),
    ("capitals", "n_upper > n_lower"),
    ("shouting", "10 * n_shouts > n_words"),
    ("stutters", "10 * n_stutters > 3 * n_words"),
)
BASE = ("too_short", "repeats")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {"base": BASE, "v1": tuple(name for name, _ in RULES)}


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _measure(texts: pa.Array) -> list[np.ndarray]:
    b = tb.words(texts)
    n_words = np.diff(b.first)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[b.off])
    lead = (b.data & 0xC0) != 0x80
    solid = ~tb.SPACES[b.data]
    own = tb.mix(np.arange(1, b.n + 1, dtype=np.uint64))  # lines and windows are compared within their text
    doc, line, check, has = tb.line_hashes(b)
    doc = doc[has]
    first, _, _ = tb.distinct(line[has] ^ own[doc], check[has] + own[doc])
    n_lines = np.bincount(doc, minlength=b.n)
    dup_lines = n_lines - np.bincount(doc[first], minlength=b.n)

    at = b.window_at(REPEAT)
    owner = own[b.doc[at]]
    _, inverse, counts = tb.distinct(tb.windows(b.h, REPEAT)[at] ^ owner, tb.windows(b.check, REPEAT)[at] + owner)
    twice = at[counts[inverse] > 1]
    cover = np.zeros(len(b.h) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + REPEAT, -1)
    covered = np.cumsum(cover[:-1]) > 0

    bang = b.data == ord("!")
    shouts = (b.end - b.start > 1) & bang[b.end - 1] & bang[np.maximum(b.end - 2, 0)] if len(b.h) else np.zeros(0, bool)
    stutters = np.zeros(len(b.h), bool)
    stutters[1:] = (b.h[1:] == b.h[:-1]) & (b.check[1:] == b.check[:-1]) & (b.doc[1:] == b.doc[:-1])
    return [
        n_words, sums(lead & solid), sums(SYMBOLS[b.data]), dup_lines, tb.per_text(b, covered), n_lines,
        sums((b.data >= 65) & (b.data <= 90)), sums((b.data >= 97) & (b.data <= 122)), tb.per_text(b, shouts), tb.per_text(b, stutters),
    ]


def _measure_parts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in parts:
        found = [_measure(x["text"]) for x in tb.blocks(pa.record_batch([texts], ["text"]))]
        columns = [pa.array(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64), pa.int64()) for i in range(len(MEASURES))]
        yield pa.StructArray.from_arrays(columns, names=list(MEASURES))


def rule_bits() -> Column:
    """The failure bits, as one expression over the measurements."""
    return sum((F.when(F.expr(when), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, when) in enumerate(RULES)), F.lit(0)).cast("long")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``rule_bits``."""
    arrow_limits(docs.sparkSession)
    own = {*MEASURES, "rule_bits", "_measured"}
    kept = [c for c in docs.columns if c not in own]
    measured = docs.select(*kept, F.arrow_udf(_measure_parts, "struct<" + ",".join(f"{m}:long" for m in MEASURES) + ">")(F.col(text)).alias("_measured"))
    return measured.select(*kept, *[F.col(f"_measured.{m}").alias(m) for m in MEASURES]).withColumn("rule_bits", rule_bits())


def fails(policy: str) -> Column:
    return F.col("rule_bits").bitwiseAND(F.lit(mask(policy))) != 0


def apply_policy(entries: DataFrame, policy: str = "v1") -> DataFrame:
    return entries.where(~fails(policy))


def ablation(entries: DataFrame, policy: str = "v1", by: str | None = None) -> DataFrame:
    """For each rule of a policy: rows it fails, rows only it rejects; and bits that any or all rows fail."""
    bits = F.col("rule_bits").bitwiseAND(F.lit(mask(policy)))
    sums = [c for r in POLICIES[policy] for c in (
        F.sum((bits.bitwiseAND(F.lit(bit(r))) != 0).cast("long")).alias(f"{r}_fails"),
        F.sum((bits == bit(r)).cast("long")).alias(f"{r}_alone"),
    )]
    groups = entries.groupBy(by) if by else entries.groupBy()
    return groups.agg(F.count(F.lit(1)).alias("n"), F.sum((bits == 0).cast("long")).alias("kept"), F.bit_or(bits).alias("any_bits"), F.bit_and(bits).alias("all_bits"), *sums)


def filter_quality(docs: DataFrame, policy: str = "v1") -> DataFrame:
    """The rows of ``docs`` that pass, with its own columns."""
    return apply_policy(ledger(docs), policy).select(*docs.columns)
