"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys.  Within each source they stand in key order, cut into slices of
equal key ranges; prefix sums of the slices' sizes and, within a slice, of its rows tell
where each row stands in its source.  A source gives whole epochs and, of the last one,
the rows up to its exact budget; the row on the cut gives a part.

Everything after the first pass works on a narrow table (id, size, source, key), so texts
are read once and never shuffled.  Hot sources are as many slices as their rows need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import original, reserved, written

#: A word: anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source that one task sums up.
ROWS_OF_SLICE = 5_000
WEIGHTS = (5.0, 2.0, 1.0)


def words_in(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def ordered_sums(rows: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, for each ``name: column`` of ``sums``, the sum over the rows that stand before in one global order.

    Rows are dealt out by ranges of the order; each range starts at the prefix sum of the
    ranges before it.  No task sees more than its range, and the sums of ranges are as many
    as the shuffle's partitions.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = written(dealt, "mix-order")
    totals = kept.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_all_{n}").over(earlier), F.lit(0)).alias(f"_from_{n}") for n in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = kept.join(starts, "_part")
    return joined.select(*rows.columns, *[(F.col(f"_from_{n}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(n) for n, c in sums.items()])


def running(rows: DataFrame, group: list[str], key: str, ties: list[str], size: str, n_rows: int, name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the rows of the group that stand before, by key and ties.

    ``key`` is a long that is spread evenly over all longs.  A distributed prefix sum:
    slices of equal key ranges, sums of slices, then rows within their slice.
    """
    bits = max(0, math.ceil(math.log2(max(1, n_rows / ROWS_OF_SLICE))))
    slice_ = F.shiftright(F.col(key), 64 - bits) if bits else F.lit(0).cast("long")
    sliced = rows.withColumn("_slice", slice_)
    sums = sliced.groupBy(*group, "_slice").agg(F.sum(size).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_slice").alias("_at"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    same = F.col("_slice") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = Window.partitionBy(*group, "_slice").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return placed.join(starts, same).withColumn(name, F.col("_start") + F.col("_within")).drop("_slice", "_at", "_start", "_within", *[f"_{g}" for g in group])


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to a table of ``source`` and ``source_size``, a row for each source.

    Sources in code point order, null last, have the weights in turn.  Together they get
    ``share`` times all sizes, each at most ``most`` times its own; what is above goes to
    the others by weight.  That ends where every source has the smaller of its cap and of
    one level times its weight; the level is found from prefix sums over the sources in the
    order in which they reach their caps.
    """
    one = sources.withColumn("_one", F.lit(1).cast("long"))
    numbered = ordered_sums(one, [F.col("source").asc_nulls_last()], {"_place": "_one"})
    weighed = numbered.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_place") % len(weights) + 1).cast("int")))
    capped = weighed.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    summed = ordered_sums(capped, [F.col("_ratio"), F.col("_place")], {"_caps": "_cap", "_weights": "_weight"})
    whole = capped.agg((F.sum("source_size") * F.lit(float(share))).alias("_share"), F.sum("_weight").alias("_weight_sum"))
    levels = summed.crossJoin(F.broadcast(whole)).withColumn("_level", (F.col("_share") - F.col("_caps")) / (F.col("_weight_sum") - F.col("_weights")))
    # the first source that its level leaves below its cap sets the level of all that follow
    found = levels.where("_level < _ratio").agg(F.min(F.struct("_ratio", "_place", "_level"))["_level"].alias("_found"))
    target = F.when(F.col("_found").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_found") * F.col("_weight")))
    # both cross joins are with the one row of an aggregate over everything
    return capped.crossJoin(F.broadcast(found)).select(*sources.columns, target.alias("target"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What each document gives to the mix: id, source, size, source_size, target, taken.

    ``size`` is the words of the text (null: none), ``taken`` the words that the mix takes,
    repeats counted: whole epochs, then one more for the rows before the source's cut.
    Runs on equal tables agree, as keys are hashes of id and source; repeated rows with
    equal ids stand beside each other.  Empty texts give nothing, an empty table no rows.
    """
    joined, _ = _placed(docs, share, most, weights, seed, id_col, text_col, source_col)
    return joined.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken")).withColumnRenamed("id", id_col)


def _key(seed: int, id_: Column, source: Column) -> Column:
    return F.xxhash64(F.lit(seed), id_.cast("long"), source.cast("string"))


def _placed(docs: DataFrame, share: float, most: float, weights: tuple[float, ...], seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    """Every row with its source's numbers, its place before it, its epochs and the words of the last one; and the sources."""
    first = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"))
    rows = written(first.withColumn("key", _key(seed, F.col("id"), F.col("source"))), "mix-rows")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = running(rows, ["source"], "key", ["id", "size"], "size", rows.count())
    budget = F.round("target").cast("long")
    shares = targets(sources, share, most, weights).select(F.col("source").alias("_source"), "source_size", "target", budget.alias("_budget"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    joined = placed.join(shares.withColumn("epochs", epochs), F.col("source").eqNullSafe(F.col("_source")))
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_budget") - F.col("epochs") * F.col("source_size") - F.col("before")))
    return joined.withColumn("rest", rest.cast("long")), shares


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time that a document is taken.

    A source's whole epochs repeat its documents; of the last epoch, the documents that stand
    before the source's cut are taken, and of the one on the cut the words up to it.  The cut
    is a key, an id and a size, so texts meet a table with one row for each source and are
    not shuffled.  Documents without words, and those after the cut of a source that gives no
    whole epoch, are not in the mix.  Other columns go with their rows, whatever their names.  Rows equal in id, source and size stand on the same side.
    """
    joined, _ = _placed(docs, share, most, weights, seed, id_col, text_col, source_col)
    # the last row that gives something is the one on the cut: a partial maximum for each source
    at_cut = F.max(F.when(F.col("rest") > 0, F.struct("key", "id", "size", "rest"))).alias("cut")
    cuts = written(joined.groupBy("source", "epochs").agg(at_cut).select(F.col("source").alias("_source"), "epochs", "cut"), "mix-cuts")
    named, own = reserved(docs)
    id_, source, text, chars = (F.col(own[c]) if c in own else None for c in (id_col, source_col, text_col, chars_col))
    rows = named.withColumn("_size", words_in(text)).withColumn("_key", _key(seed, id_, source))
    met = rows.join(cuts, source.cast("string").eqNullSafe(F.col("_source")))
    here = F.struct(F.col("_key").alias("key"), id_.cast("long").alias("id"), F.col("_size").alias("size"))
    cut = F.struct(F.col("cut.key").alias("key"), F.col("cut.id").alias("id"), F.col("cut.size").alias("size"))
    extra = F.when(F.col("cut").isNull() | (here > cut), 0).when(here.eqNullSafe(cut), F.col("cut.rest")).otherwise(F.col("_size")).cast("long")
    times = F.concat(F.array_repeat("_size", F.col("epochs").cast("int")), F.when(extra > 0, F.array(extra)).otherwise(F.array().cast("array<bigint>")))
    taken = met.where("_size > 0").withColumn("_words", F.explode(times))
    out = taken.withColumn(own[text_col], F.when(F.col("_words") < F.col("_size"), head_words(text, F.col("_words"))).otherwise(text))
    if chars is not None:
        out = out.withColumn(own[chars_col], F.length(text).cast(docs.schema[chars_col].dataType))
    return original(out, docs)


def head_words(text: Column, n: Column) -> Column:
    """A text up to its n-th word, white space kept."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)), F.lit(1), n.cast("int")), "")
