"""Mixing sources to target weights, to the word.

Every row gets a hash-random key; within its source the rows are put in key order by a range
shuffle, prefix sums of their sizes say how many words come before each row, and the source is cut
exactly where its budget ends. A budget above the source's size first takes whole epochs. The cut
row gives only the words up to the budget, so a source contributes its target rounded down.

Cases: a null text has size 0 and is never taken; a null source is a source of its own, last in
order; rows equal in every column used are interchangeable and each takes its own share; an empty
table gives an empty mix; sources without words have target 0. Extra columns are ignored by
``plan`` and kept by ``apply_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .arrowtext import WORD
from .names import columns
from .prefix import running

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """Spread evenly, the same in every run, different for rows that differ in id or text."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(seed), blank(doc_id), blank(text)))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from rows of ``source, size``.

    Sources weigh by code-point order, null last. A source's target stops at ``max_epochs`` times
    its size; the excess goes to the others by weight, until none is above. The loop looks at sums
    over one row per source; only those sums come to the driver.
    """
    totals = cut_lineage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ordered = running(totals, [], [F.col("source").asc_nulls_last()], F.lit(1), "_mix_at")
    placed = cut_lineage(ordered.select(
        "source", "source_size", (F.col("source_size") * float(max_epochs)).alias("_mix_cap"),
        F.element_at(cycle, (F.col("_mix_at") % len(weights) + 1).cast("int")).alias("_mix_w"),
    ))
    goal = share * (placed.agg(F.sum("source_size")).first()[0] or 0)
    capped, stopped = F.lit(False), 0
    while True:
        cap, free, now = placed.agg(
            F.sum(F.when(capped, F.col("_mix_cap"))), F.sum(F.when(~capped, F.col("_mix_w"))), F.count(F.when(capped, 1))
        ).first()
        rest, free = F.lit(float(goal - (cap or 0))), F.lit(float(free or 1))
        if now == stopped and now:
            break
        new = F.col("_mix_cap") * free < rest * F.col("_mix_w")
        stopped, capped = now, capped | new
        if not placed.filter(new).take(1):
            break
    target = F.when(capped, F.col("_mix_cap")).otherwise(rest * F.col("_mix_w") / free)
    return placed.select("source", "source_size", target.alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, source, _mix_key, size, source_size, target, taken``.

    The text is read once, to be counted and hashed; what is shuffled is narrow.
    """
    sized = cut_lineage(docs.select(
        "doc_id", "source", random_key(F.col("doc_id"), F.col("text"), seed).alias("_mix_key"), words(F.col("text")).alias("size")
    ))
    goal = targets(sized, weights, share, max_epochs).withColumnRenamed("source", "_mix_source")
    placed = running(sized, ["source"], [F.col("_mix_key"), F.col("doc_id"), F.col("size")], F.col("size"), "_mix_before")
    budget, whole = F.floor("target").cast("long"), F.col("source_size")
    epochs = F.when(whole > 0, F.floor(budget / F.greatest(whole, F.lit(1)))).otherwise(0).cast("long")
    rest = budget - epochs * whole
    part = F.least(F.col("size"), F.greatest(rest - F.col("_mix_before"), F.lit(0)))
    return placed.join(broadcast_if_small(goal, goal.count()), F.col("source").eqNullSafe(F.col("_mix_source"))).select(
        "doc_id", "source", "_mix_key", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


#: Copies of a row spelt out by one task.
COPIES = 4096


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows, with the columns of ``docs``: each text as often as it is taken.

    Rows that are equal in id, text and source form one group, whose words are taken together: whole
    copies first, then one text cut after its last taken word. Of rows that differ in other columns
    the one with the smallest hash stands for the group.
    """
    of_source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("_mix_of")
    group = ["_mix_key", "_mix_of"]
    mixed = cut_lineage(plan(docs, **options).groupBy("_mix_key", of_source).agg(
        F.sum("taken").alias("_mix_taken"), F.max("size").alias("_mix_size")
    ).filter("_mix_taken > 0"))
    key = random_key(F.col("doc_id"), F.col("text"), options.get("seed", SEED)).alias("_mix_key")
    hashed = F.xxhash64(*columns(docs, [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]))
    packed = docs.select(key, of_source, F.struct(*columns(docs)).alias("_mix_row"), hashed.alias("_mix_hash"))
    one = packed.groupBy(*group).agg(F.min_by("_mix_row", "_mix_hash").alias("_mix_row"))
    copies = one.join(mixed, group).select(
        *group, "_mix_row", F.expr("_mix_taken div _mix_size").alias("_mix_whole"), F.expr("_mix_taken % _mix_size").alias("_mix_part")
    )
    most = mixed.agg(F.max(F.expr("_mix_taken div _mix_size"))).first()[0] or 0
    # runs of copies; the cut text comes with the first
    runs = copies.withColumn("_mix_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"greatest(_mix_whole - 1, 0) div {COPIES}"))))
    if most > COPIES:
        runs = runs.repartition(*group, "_mix_run")
    times = F.expr(
        f"concat(array_repeat(-1L, cast(least({COPIES}, _mix_whole - _mix_run * {COPIES}) as int)), if(_mix_part > 0 and _mix_run = 0, array(_mix_part), array()))"
    )
    each = runs.select("_mix_row", F.explode(times).alias("_mix_cut"))
    of = lambda name: F.col("_mix_row").getField(name)
    cut = F.when(F.col("_mix_cut") < 0, of("text")).otherwise(first_words(of("text"), F.col("_mix_cut")))
    size = F.when(F.col("_mix_cut") < 0, of("n_chars")).otherwise(F.length(cut)).cast("long") if "n_chars" in docs.columns else None
    new = {"text": cut, "n_chars": size}
    return each.select(*((new[c] if c in new else of(c)).alias(c) for c in docs.columns))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, with its white space."""
    gaps = F.regexp_extract_all(text, F.lit(rf"([\x20\x09-\x0D]*{WORD})"), F.lit(1))
    return F.array_join(F.slice(gaps, F.lit(1), n.cast("int")), "")
