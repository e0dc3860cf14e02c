"""Questions that restrict time to any window and amounts to any bounds, answered in bulk.

No question meets a record. The bounds that the distinct plans name cut time and amounts into bins: every
bound is a bin and so is every gap between two. A record falls into one cell (time bin, amount bin), and a plan
asks for a rectangle of cells, so nothing has to be compared again at its edges. Bins are the leaves
of a binary tree, a range of bins is a few of its nodes, and a rectangle a few pairs of nodes. Records are summed
up by cell (counts, and the first few rows in the order a plan shows them), cells by the pairs of nodes
that some plan uses, and plans are joined to pairs of nodes by equality.

Plans are taken in blocks of :data:`BLOCK` by hash, which bounds what is sent to tasks; every block reads the
records again. A frequent cell is cut to its count and its first rows inside each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf import schema as S
from sheaf.functions import questions as Q
from sheaf.operators.analytics import newest_first
from sheaf.session import union_all, written

#: Distinct plans that are answered in one pass over the records.
BLOCK = 4096

# How a question names a quarter, a span of days, a year and a bound.
QUARTER = r"q([1-4])[ /-]*(\d{4})"
DAYS = r"(\d{4}-\d{2}-\d{2})\s*(?:to|and|until|-)\s*(\d{4}-\d{2}-\d{2})"
YEAR = r"\bin (\d{4})\b"
OVER = r"(?:over|above|more than|greater than)\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)"
UNDER = r"(?:under|below|less than)\s*\$?([0-9][0-9,]*(?:\.[0-9]+)?)"

SPEC = ["op", "network", "type", "from_ts", "to_ts", "over", "under"]


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def range_plans(questions: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Adds ``op, network, type, from_ts, to_ts, over, under`` to a table with ``query``.

    The window is a span of days (both included), a quarter, a month or a year, the first of them that
    is named, and goes up to but not including ``to_ts``. Amounts lie strictly above ``over`` and below
    ``under``. What is not named, or does not exist, does not restrict.
    """
    text = F.lower("query")
    first_day, last_day = (_found(text, DAYS, g).try_cast("date") for g in (1, 2))
    quarter = F.concat(_found(text, QUARTER, 2), F.lit("-"), F.lpad((_found(text, QUARTER).cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01"))
    quarter = quarter.try_cast("date")
    month = Q.month_start(Q.first_of_month(text, word_boundary))
    year = F.concat(_found(text, YEAR), F.lit("-01-01")).try_cast("date")
    spans = [(first_day, F.date_add(last_day, 1)), (quarter, F.add_months(quarter, 3)), (month, F.add_months(month, 1)), (year, F.add_months(year, 12))]
    start = end = None
    for a, z in spans:
        both = a.isNotNull() & z.isNotNull()
        start = F.when(both, a) if start is None else start.when(both, a)
        end = F.when(both, z) if end is None else end.when(both, z)

    def bound(pattern: str) -> Column:
        return F.replace(_found(text, pattern), F.lit(","), F.lit("")).try_cast("double")

    counting = F.contains(text, F.lit("how many"))
    recent = F.contains(text, F.lit("recent"))
    return questions.select(
        "*",
        F.when(counting, "count").when(recent, "newest").otherwise("sample").alias("op"),
        Q.network_in(text, word_boundary).alias("network"),
        F.when(F.contains(text, F.lit("treasury")), "TreasuryProposal").alias("type"),
        start.cast("timestamp").alias("from_ts"),
        end.cast("timestamp").alias("to_ts"),
        bound(OVER).alias("over"),
        bound(UNDER).alias("under"),
    )


class Bins:
    """Bins around sorted bounds: bin 2i+1 is bound i itself, bin 2i the gap before it; the last is for null."""

    def __init__(self, bounds) -> None:
        self.bounds = np.unique(np.asarray([b for b in bounds if b is not None]))
        self.null = 2 * len(self.bounds) + 1
        self.size = 1 << int(self.null).bit_length()

    def of(self, values: np.ndarray, missing: np.ndarray) -> np.ndarray:
        """The bin of each value. Nothing is above NaN, as Spark orders numbers."""
        place = np.searchsorted(self.bounds, values, "left")
        inside = place < len(self.bounds)
        exact = np.zeros(len(values), bool)
        exact[inside] = self.bounds[place[inside]] == values[inside]
        return np.where(missing, self.null, 2 * place + exact)

    def at(self, bound) -> int:
        return 2 * int(np.searchsorted(self.bounds, bound)) + 1

    def window(self, low, high) -> tuple[int, int]:
        """Bins of ``low <= x < high``; with neither also those of null."""
        if low is None and high is None:
            return 0, self.null + 1
        return (0 if low is None else self.at(low)), (self.null if high is None else self.at(high))

    def between(self, low, high) -> tuple[int, int]:
        """Bins of ``low < x < high``; with neither also those of null."""
        a, z = self.window(low, high)
        return (a if low is None else a + 1), z

    def nodes(self, low: int, high: int) -> Iterator[int]:
        """The fewest nodes of the tree that hold the bins from low to high. Node 1 is the root, and
        nodes 2n and 2n+1 are below node n."""
        a, z = low + self.size, max(low, high) + self.size
        while a < z:
            if a & 1:
                yield a
                a += 1
            if z & 1:
                z -= 1
                yield z
            a, z = a >> 1, z >> 1

    def above(self, column: Column) -> Column:
        """A bin's leaf and all nodes above it."""
        levels = self.size.bit_length()
        return F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.call_function("shiftright", column + F.lit(self.size), k))


def _restriction(network: Column, type: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x1e")) for c in (network, type)])


def answer_ranges(plans: DataFrame, records: DataFrame, n: int = S.EXAMPLES, block: int = BLOCK) -> DataFrame:
    """Adds ``count`` and ``examples`` (ids in order) to the plans of :func:`range_plans`.

    A count's examples and those of ``newest`` are the newest records, those of ``sample`` the first by id.
    Equal plans are answered once. A restriction's null means any, also records without that value.
    """
    plans = written(plans, "range-plans")
    spec = F.md5(F.to_json(F.struct(*SPEC)).cast("binary"))
    specs = written(plans.select(spec.alias("_spec"), *SPEC).dropDuplicates(["_spec"]), "range-specs")
    blocks = max(1, -(-specs.count() // block))
    micros = [F.unix_micros(c).alias(c) for c in ("from_ts", "to_ts")]
    parts = []
    for b in range(blocks):
        mine = specs.filter(F.pmod(F.xxhash64("_spec"), F.lit(blocks)) == b)
        asked = mine.select("_spec", "op", "network", "type", *micros, "over", "under").collect()
        if asked:
            parts.append(written(_answers(asked, records, n), "range-answers"))
    if not parts:
        kind = records.schema["id"].dataType.simpleString()
        parts = [plans.sparkSession.createDataFrame([], f"_spec string, count long, examples array<{kind}>")]
    found = plans.withColumn("_spec", spec).join(union_all(*parts), "_spec", "left").drop("_spec")
    none = F.array().cast(parts[0].schema["examples"].dataType)
    return found.withColumn("count", F.coalesce("count", F.lit(0))).withColumn("examples", F.coalesce("examples", none))


def _answers(asked: list, records: DataFrame, n: int) -> DataFrame:
    spark = records.sparkSession
    times = Bins(t for r in asked for t in (r.from_ts, r.to_ts))
    amounts = Bins(a for r in asked for a in (r.over, r.under))

    @F.pandas_udf("int")
    def time_bin(column: pd.Series) -> pd.Series:
        missing = column.isna().to_numpy()
        return pd.Series(times.of(column.fillna(0).to_numpy(np.int64), missing))

    @F.pandas_udf("int")
    def amount_bin(known: pd.Series, column: pd.Series) -> pd.Series:
        return pd.Series(amounts.of(column.to_numpy(np.float64), ~known.to_numpy(bool)))

    rows = []
    for r in asked:
        key = "\x1f".join("\x1e" if x is None else x for x in (r.network, r.type))
        right = [*amounts.nodes(*amounts.between(r.over, r.under))]
        rows += [(r._spec, r.op == "sample", key, t, a) for t in times.nodes(*times.window(r.from_ts, r.to_ts)) for a in right]
    wanted = written(spark.createDataFrame(rows, "_spec string, by_id boolean, key string, t int, a int"), "range-nodes")
    in_time = wanted.select("key", "t").distinct()
    pairs = wanted.select("key", "t", "a").distinct()

    cell = ["network", "type", "tb", "ab"]
    binned = records.select(
        "id", "network", "type", "created_at",
        time_bin(F.unix_micros(F.col("created_at").cast("timestamp"))).alias("tb"),
        amount_bin(F.col("amount_numeric").isNotNull(), F.col("amount_numeric").cast("double")).alias("ab"),
    )
    nothing = F.lit(None).cast("string")
    keys = F.array_distinct(F.array(*[_restriction(x, y) for x in (F.col("network"), nothing) for y in (F.col("type"), nothing)]))

    def noded(cells: DataFrame) -> DataFrame:
        """Rows of cells under each pair of nodes that a plan uses."""
        timed = cells.withColumn("key", F.explode(keys)).withColumn("t", F.explode(times.above(F.col("tb"))))
        timed = timed.join(in_time, ["key", "t"], "left_semi").withColumn("a", F.explode(amounts.above(F.col("ab"))))
        return timed.join(pairs, ["key", "t", "a"], "left_semi")

    sums = noded(binned.groupBy(*cell).agg(F.count("*").alias("n"))).groupBy("key", "t", "a").agg(F.sum("n").alias("n"))
    counts = wanted.join(sums, ["key", "t", "a"]).groupBy("_spec").agg(F.sum("n").alias("count"))

    def best(order: list[Column], by_id: bool) -> DataFrame:
        def cut(df: DataFrame, *by: str) -> DataFrame:
            place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
            return df.withColumn("position", place).filter(F.col("position") <= n)

        nodes = cut(noded(cut(binned, *cell)), "key", "t", "a").select("key", "t", "a", "id", "created_at")
        return cut(wanted.filter(F.col("by_id") == by_id).join(nodes, ["key", "t", "a"]), "_spec").select("_spec", "position", "id")

    listed = union_all(best(newest_first(), False), best([F.col("id").asc()], True))
    examples = F.transform(F.sort_array(F.collect_list(F.struct("position", "id"))), lambda x: x["id"])
    return counts.join(listed.groupBy("_spec").agg(examples.alias("examples")), "_spec", "left")
