"""CSV files whose quoted texts contain line breaks, read by many tasks a file.

Spark splits a file at line breaks, but whether a line begins inside a quoted text depends on everything
before it. A line turns either state, outside or inside quotes, into one of the two: it keeps both, swaps
them, or ends in the same one whatever came before. So the state at any place is that of the last line of the
third kind, turned by the number of swaps since. Each split finds this for its own lines, a window over the
splits (one row each) carries it across the file, and then every line knows whether it begins a record. Only
records that cross the end of a split are put together from two or more of them.

Quotes and escaped quotes are ``"``, and a quote opens a text at the beginning of a field only. The names come
from the header of the first file, and the first record of every file is its header. Empty lines are skipped,
missing fields are null, further ones are dropped. A text that is never closed reaches to the end of its
file. Where the header ends in a carriage return, so does every line, and a text's line breaks become ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage

#: The rest of a quoted text; complete fields with the commas behind them; a text that stays open.
_INNER = r'[^"]*+(?:""[^"]*+)*+'
_FIELDS = rf'(?:(?:"{_INNER}"[^,]*+|[^",][^,]*+|),)*+'
_OPEN = rf'{_FIELDS}"{_INNER}\z'


def open_after(line: Column, inside: bool) -> Column:
    """Whether the line ends inside a quoted text if it begins inside one, or outside."""
    return line.rlike(rf'\A(?:{_INNER}\z|{_INNER}"[^,]*+,{_OPEN})' if inside else rf"\A{_OPEN}")


def _state(fixed: str, swaps: str, begin: Column | None = None) -> Column:
    """Inside (1) or outside (0), from the last fixed state with the swaps before it, or else from ``begin``."""
    start = F.lit(0) if begin is None else begin
    return F.when(F.col(fixed).isNull(), start + F.col(swaps)).otherwise(
        F.col(f"{fixed}.state") + F.col(swaps) - F.col(f"{fixed}.swaps")
    ) % 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, n, line`` and what is known from the split alone: ``swaps`` and ``fixed`` up to the line."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"),
    )
    out, ins = open_after(F.col("line"), False).cast("int"), open_after(F.col("line"), True).cast("int")
    turned = raw.withColumns({"_out": out, "_in": ins})
    so_far = Window.partitionBy("file", "start").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    counted = turned.withColumn("swaps", F.sum((F.col("_out") > F.col("_in")).cast("int")).over(so_far))
    settled = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("state"), "swaps"))
    return counted.withColumn("fixed", F.last(settled, ignorenulls=True).over(so_far)).drop("_out", "_in")


def _splits(lines: DataFrame) -> DataFrame:
    """``file, start, begin, crlf``: the state at the beginning of each split."""
    ends = lines.groupBy("file", "start").agg(
        F.max("swaps").alias("_swaps"), F.max_by("fixed", "n").alias("_fixed"), F.min_by("line", "n").alias("_first")
    )
    # the same two figures, over splits in place of lines
    by_file = Window.partitionBy("file").orderBy("start")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    total = ends.withColumn("_earlier", F.coalesce(F.sum("_swaps").over(before), F.lit(0)))
    settled = F.when(
        F.col("_fixed").isNotNull(),
        F.struct(F.col("_fixed.state").alias("state"), (F.col("_earlier") + F.col("_fixed.swaps")).alias("swaps")),
    )
    known = total.withColumn("_known", F.last(settled, ignorenulls=True).over(before))
    first = F.first(F.col("_first").endswith("\r")).over(by_file)
    return known.select("file", "start", _state("_known", "_earlier").alias("begin"), first.alias("crlf"))


def _pieces(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``file, start, record, piece, open``: records of each split; number 0 goes on from an earlier one."""
    joined = lines.join(splits, ["file", "start"])
    after = joined.withColumn("_after", _state("fixed", "swaps", F.col("begin")))
    in_split = Window.partitionBy("file", "start").orderBy("n")
    begins = 1 - F.coalesce(F.lag("_after").over(in_split), F.col("begin"))
    counted = after.withColumn("_begins", begins).withColumn(
        "record", F.sum("_begins").over(in_split.rowsBetween(Window.unboundedPreceding, 0))
    )
    line = F.when(F.col("crlf"), F.regexp_replace("line", r"\r\z", "")).otherwise(F.col("line"))
    members = F.sort_array(F.collect_list(F.struct("n", line.alias("line"))))
    return counted.groupBy("file", "start", "record").agg(
        F.array_join(F.transform(members, lambda m: m["line"]), "\n").alias("piece"), F.max_by("_after", "n").alias("open")
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record, first``: the text of every record, and whether it is the first of its file."""
    lines = _lines(spark, path)
    splits = cut_lineage(_splits(lines))
    pieces = cut_lineage(_pieces(lines, broadcast_if_small(splits, splits.count(), 256)))
    whole = pieces.filter("record > 0 AND open = 0")
    # what crosses the end of a split: one piece begins it, later ones are number 0 of their splits
    broken = pieces.filter("record = 0 OR open = 1")
    owner = F.last(F.when(F.col("record") > 0, F.col("start")), ignorenulls=True)
    order = Window.partitionBy("file").orderBy("start", "record")
    owned = broken.withColumn("_owner", owner.over(order)).groupBy("file", "_owner").agg(
        F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("_p"), F.max("record").alias("record")
    )
    joined = owned.select(
        F.array_join(F.transform("_p", lambda p: p["piece"]), "\n").alias("piece"), F.col("_owner").alias("start"), "record"
    )
    both = whole.select("piece", "start", "record").unionByName(joined)
    first = (F.col("start") == 0) & (F.col("record") == 1)
    return both.select(F.col("piece").alias("record"), first.alias("first"))


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, as Spark's own reader with ``multiLine`` gives them, in no order."""
    options = {"quote": '"', "escape": '"'}
    names = spark.read.options(header=True, multiLine=True, **options).csv(path).columns  # reads the first record
    if not names:
        return spark.read.options(header=True, multiLine=True, **options).csv(path)
    rows = records(spark, path).filter((F.col("record") != "") & ~F.col("first"))
    fields = ", ".join(f"c{i} string" for i in range(len(names)))
    return rows.select(F.from_csv("record", fields, options).alias("_r")).select(
        *[F.col(f"_r.c{i}").alias(name) for i, name in enumerate(names)]
    )
