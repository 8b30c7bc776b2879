"""Quality rules as a ledger of failure bits.

Every rule looks at a document once. ``ledger`` stores its measurements and one long whose bit
``k`` says that rule ``k`` failed. A policy is a named, versioned set of rules; applying it, or
asking what would change without one of its rules, only needs bitwise operations on the ledger,
so a new policy never reads a text again.

Null texts count as empty: no words, every measurement 0, the word-count rule fails. Repeated rows
are judged one by one. The ledger carries the columns named in ``keep``; one that has the name of a
ledger column comes out with ``_source`` behind its name. An empty table gives an empty ledger.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrowtext import Words, mix, rolling, rows_sum, slices, texts
from .names import columns, renamed

WINDOW = 8
MEASURES = [
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper",
]

#: Rule name -> failure condition over the measurements. The position is the bit; only append.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 5 * word_chars",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 60 * n_letters",
    "few_letters": "100 * n_letters < 50 * word_chars",
    "long_words": "word_chars > 40 * n_words",
}

#: Policy version -> its rules.
POLICIES: dict[str, list[str]] = {
    "base-1": ["few_words", "repeated_windows"],
    "prose-1": ["few_words", "repeated_windows", "symbols", "repeated_lines", "shouting", "few_letters", "long_words"],
}


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of a slice of texts."""
    n, words = len(column), Words(column)
    chars, space, symbol, letter, upper = characters(column)
    lists = pc.split_pattern(column, "\n")
    lines = lists.flatten()
    full = pc.match_substring_regex(lines, r"[^\x20\x09-\x0D]")
    line_row = pc.list_parent_indices(lists).filter(full).to_numpy().astype(np.int64)
    line_code = lines.filter(full).dictionary_encode().indices.to_numpy().astype(np.int64)
    n_lines = rows_sum(line_row, n)
    distinct = rows_sum(np.unique(line_code * n + line_row) % n, n) if n else n_lines
    return {
        "n_words": words.counts,
        "word_chars": chars - space,
        "n_symbols": symbol,
        "n_lines": n_lines,
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": repeated_words(words, n),
        "n_letters": letter,
        "n_upper": upper,
    }


@cache
def _classes() -> np.ndarray:
    """A byte per code point: 1 white space, 2 symbol, 4 letter, 8 upper-case letter."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        category = unicodedata.category(chr(point))
        table[point] = 4 * (category[0] == "L") + 8 * (category == "Lu")
    table[[0x20, *range(0x09, 0x0E)]] |= 1
    table[[ord(c) for c in "#*$%&|<>"]] |= 2
    return table


def characters(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Code points of each text: all, white space, symbols, letters, upper-case letters."""
    length = pc.utf8_length(column).to_numpy().astype(np.int64)
    whole = "".join(column.to_pylist()).encode("utf-32-le", "surrogatepass")
    kind = _classes()[np.frombuffer(whole, np.uint32)]
    edge = np.concatenate([[0], np.cumsum(length)])
    full = np.flatnonzero(length)

    def total(bit: int) -> np.ndarray:
        out = np.zeros(len(length), np.int64)
        if len(full):
            out[full] = np.add.reduceat((kind & bit) > 0, edge[full], dtype=np.int64)
        return out

    return length, total(1), total(2), total(4), total(8)


def repeated_words(words: Words, n: int) -> np.ndarray:
    """Words inside windows of eight words that the same text has twice or more.

    Windows are compared by 64-bit hashes of their words and their row.
    """
    at = np.arange(max(0, len(words.codes) - WINDOW + 1))
    row = words.row[at]
    inside = at + WINDOW <= words.starts[row + 1]
    at, key = at[inside], rolling(mix(words.codes), WINDOW)[inside] ^ mix(~row[inside])
    ordered = np.sort(key)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    twice = at[np.isin(key, again)] if len(again) else at[:0]
    edge = np.zeros(len(words.codes) + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    return rows_sum(words.row[np.cumsum(edge[:-1]) > 0], n)


def bits(rules: list[str]) -> int:
    return sum(1 << list(RULES).index(name) for name in rules)


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the measurements, and ``fail_bits``; one row per input row."""
    names = renamed(keep, [*MEASURES, "fail_bits", "_text"])
    inner = [f"_kept_{i}" for i in range(len(keep))]
    chosen = docs.select(*(c.alias(n) for c, n in zip(columns(docs, keep), inner)), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = measure(texts(batch, "_text"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(found[m]) for m in MEASURES)], names=[*inner, *MEASURES])

    schema = StructType(chosen.schema.fields[:-1] + [StructField(m, LongType()) for m in MEASURES])
    measured = chosen.mapInArrow(run, schema)
    failed = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    kept = [F.col(i).alias(n) for i, n in zip(inner, names)]
    return measured.select(*kept, *MEASURES, reduce(Column.bitwiseOR, failed).alias("fail_bits"))


def passes(policy: str) -> Column:
    """Whether the ledger row passes a policy version."""
    return F.col("fail_bits").bitwiseAND(F.lit(bits(POLICIES[policy])).cast("long")) == 0


def ablate(rows: DataFrame, policy: str) -> DataFrame:
    """What each rule of a policy does: ``rule, failed, only_this, kept_without``.

    ``failed`` documents fail the rule, ``only_this`` fail no other rule of the policy, and
    ``kept_without`` documents the policy would keep without the rule. The ledger is aggregated to
    its distinct bit patterns first (at most 2^rules rows), the rest is bitwise arithmetic on them.
    An empty ledger gives zeros.
    """
    whole = bits(POLICIES[policy])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    ones = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bits([r])).cast("long").alias("bit")) for r in POLICIES[policy]])
    zero = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    each = patterns.unionByName(zero).select("b", "n", F.explode(ones).alias("r")).select("b", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("b").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("b") == F.col("bit"), F.col("n")).otherwise(0)).alias("only_this"),
        F.sum(F.when((F.col("b") == F.col("bit")) | (F.col("b") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )
