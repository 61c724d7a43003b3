"""Mixing sources to target weights, with DataFrame functions alone.

Each source gets a share of a word budget. Its complete epochs take every
document; the part of an epoch that remains goes by weighted sampling without
replacement: each document draws an exponential key divided by its quality
weight, and the smallest keys are taken until their sizes reach the budget.

The order inside a source is never sorted in one task. Keys fall into narrow
bins; the bins' sums, few rows, show the bin in which the budget ends, and only
that bin's documents are put in order. There are as many bins as keep one small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked_lookup, packed, written
from .merkle import ranked

#: Weights of the sources in order of their names, repeated.
WEIGHTS = (3, 1, 2)
#: The mix holds this many times all words.
SHARE = 1.5
#: No document is taken more often.
MOST = 2
#: Bins of the keys: at least so many, and one for each so many rows, so that a bin is put in order by one task at any size.
LEAST_BINS, BIN_ROWS = 4096, 50_000
SEED = "mix-1"
#: The order of a source's rows.
PLACE = ("_key", "doc_id", "_size", "_hash")


def word_count(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """An even draw in (0, 1) that the seed and the key decide, alike in every engine with md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 48)


def sampling_key(key: Column, weight: Column, seed: str = SEED) -> Column:
    """The exponential draw of a row: the smaller, the earlier it is taken."""
    return -F.log(uniform(key, seed)) / weight


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from ``sizes(source, source_size)``, one row per source.

    Sources in code-point order, null last, take the weights in turn. A target
    is the weight times a common level, stopped at ``most`` times the source's
    size; the level is that at which all targets sum to the budget. Sorted by
    the level at which they stop, the sources that stop are the first ones.
    """
    all_rows = Window.partitionBy()
    named = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    named = named.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int")))
    named = named.withColumn("_cap", most * F.col("source_size").cast("double")).withColumn("_budget", share * F.sum("source_size").over(all_rows))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_n")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward)
    named = named.withColumn("_level", level)
    named = named.withColumn("_level", F.max(F.when(F.col("_cap") >= F.col("_level") * F.col("_w"), F.col("_level"))).over(all_rows))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return named.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def quality_weight(text: Column, size: Column) -> Column:
    """1, halved below 50 words and halved where the mean word is outside 3 to 10 characters."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return F.when(size < 50, 0.5).otherwise(1.0) * F.when(F.coalesce(mean.between(4, 11), F.lit(False)), 1.0).otherwise(0.5)


def measured(docs: DataFrame, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with _size, _hash (of the text), _key (the sampling key), _place (of the key between 0 and 1) and _source (never null).

    A row without an id draws by its text.
    """
    docs = docs.withColumn("_size", word_count(F.col("text")))
    weight = quality_weight(F.col("text"), F.col("_size")) if weight is None else weight
    docs = docs.withColumn("_hash", F.xxhash64("text"))
    docs = docs.withColumn("_key", sampling_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))), weight, seed))
    docs = docs.withColumn("_place", 1 - F.exp(-F.col("_key")))
    return docs.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))


def budgets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: _source, source_size, target, _epochs and _last.

    ``rows``, already written, has doc_id, source, _source, _size, _hash, _key and _place.
    ``_last`` is the place (key, doc_id, size, hash) of the last document that the
    partial epoch takes, or one before all of its bin if it takes none there; of
    the ``_run`` rows that share this place it takes ``_taken``. ``_bins`` is the
    number of bins, ``_end`` the bin in which the budget ends. The number changes no
    result.
    """
    bins = max(LEAST_BINS, rows.count() // BIN_ROWS)
    rows = rows.withColumn("_bin", _bin(F.lit(bins)))
    sums = written(rows.groupBy("source", "_source", "_bin").agg(F.sum("_size").alias("_sum")), "mix-bins")
    sizes = sums.groupBy("source", "_source").agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most).withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null"))).drop("source")
    targets = targets.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long"))
    targets = written(targets.withColumn("_rest", F.greatest(F.col("target") - F.col("_epochs") * F.col("source_size"), F.lit(0.0))), "mix-targets")
    ahead = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).join(targets, "_source")
    ends = written(ends.where("_ahead < _rest and _ahead + _sum >= _rest").select("_source", F.col("_bin").alias("_end"), "_ahead", "_rest"), "mix-ends")
    # only the documents of the bin in which a budget ends are put in order
    cut = checked_lookup(rows, ends, "_source", F.xxhash64("doc_id", "_hash")).where("_bin = _end and _size > 0")
    # rows that share a place are one run, taken by number
    cut = cut.groupBy("_source", F.struct(*PLACE).alias("_last"), "_ahead", "_rest").agg(F.count("*").alias("_run"))
    upto = F.sum(F.col("_last._size") * F.col("_run")).over(Window.partitionBy("_source").orderBy("_last").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_ahead")
    behind, size = F.col("_rest") - (F.col("_upto") - F.col("_last._size") * F.col("_run")), F.col("_last._size")
    over = F.col("_upto") - F.col("_rest")
    taken = F.when(F.col("_run") == 1, (over <= size - over).cast("long")).otherwise(F.least(F.floor((2 * behind + size) / (2 * size)), F.col("_run")))
    cut = cut.withColumn("_upto", upto).withColumn("_taken", taken).where("_taken > 0").groupBy("_source").agg(F.max(F.struct("_last", "_run", "_taken")).alias("_in"))
    none = F.struct((F.col("_end") / F.lit(bins)).alias("_key"), F.lit(None).cast(rows.schema["doc_id"].dataType).alias("doc_id"), F.lit(-1).cast("long").alias("_size"), F.lit(0).cast("long").alias("_hash"))
    last = ends.join(cut, "_source", "left").select("_source", F.coalesce("_in._last", none).alias("_last"), F.coalesce("_in._run", F.lit(1)).alias("_run"), F.coalesce("_in._taken", F.lit(1)).alias("_taken"), "_end")
    return written(targets.join(last, "_source", "left").drop("_rest").withColumn("_bins", F.lit(bins)), "mix-budgets")


def _bin(bins: Column) -> Column:
    return F.least(F.floor(F.col("_place") * bins), bins - 1).cast("int")


def with_copies(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and _copies: how often the mix takes each.

    Where a budget ends among rows that share a place, these are numbered, by as
    many tasks as they need, and the first ones are taken.
    """
    rows = checked_lookup(rows, budget, "_source", F.xxhash64("doc_id", "_hash")).withColumn("_bin", _bin(F.col("_bins")))
    within = (F.col("_bin") < F.col("_end")) | ((F.col("_bin") == F.col("_end")) & (F.struct(*PLACE) <= F.col("_last")))
    copies = lambda part: (F.col("_epochs") + F.coalesce(part, F.lit(False)).cast("int")).cast("long")
    if budget.where("_taken < _run").isEmpty():
        return rows.withColumn("_copies", copies(within))
    split = F.coalesce((F.col("_taken") < F.col("_run")) & (F.col("_bin") == F.col("_end")) & F.struct(*PLACE).eqNullSafe(F.col("_last")), F.lit(False))
    equal = ranked(rows.where(split), "_source", [], "mix-equal")
    whole = rows.where(~split).withColumn("_copies", copies(within))
    return whole.unionByName(equal.withColumn("_copies", copies(F.col("_rank") < F.col("_taken"))).select(*whole.columns))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with one row for each time that the mix takes it.

    ``weight`` is a quality weight of a row, above 0: any column of ``docs``, such
    as a classifier's score. A null or empty text has size 0; a null source is a source of its own, last
    in order. Rows that repeat everything share a place in the order; where the
    budget ends among them, as many are taken as it asks for. An empty table gives an empty mix. A
    rerun over the same rows takes the same documents.
    """
    # the rows travel in a struct, so that columns of any name come out as they went in
    own = [F.col("doc_id"), F.col("text"), F.col("source")] + ([] if weight is None else [weight.alias("_weight")])
    weight = None if weight is None else F.col("_weight")
    rows = measured(docs.select(*own), weight, seed).drop("text", "_weight")
    budget = budgets(written(rows, "mix-rows"), weights, share, most)
    kept = with_copies(measured(docs.select(packed(docs), *own), weight, seed), budget)
    return kept.where("_copies > 0").select("_row", F.explode(F.expr("sequence(1L, greatest(_copies, 1L))"))).select("_row.*")


def op4_source_mixing(spark, sf_dir: str, weight: Column | None = None) -> DataFrame:
    """For every document the words that the mix takes of it.

    ``weight`` is a quality weight above 0 from the columns of documents; without
    one it is ``quality_weight``, which the text alone decides.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = written(measured(docs, weight).drop("text"), "mix-rows")
    found = with_copies(rows, budgets(rows))
    return found.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.col("_copies")).alias("taken"))


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null|' || md5(coalesce(text, '')))), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
    / ((CASE WHEN size < 50 THEN 0.5 ELSE 1.0 END) * (CASE WHEN coalesce(length(text)::DOUBLE / greatest(size, 1) BETWEEN 4 AND 11, false) THEN 1.0 ELSE 0.5 END)) AS key
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM k GROUP BY source
), w AS (
  SELECT source, source_size, n, [3.0, 1.0, 2.0][(n % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
), l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), m AS (
  SELECT *, max(CASE WHEN cap >= level * w THEN level END) OVER () AS common FROM l
), t AS (
  SELECT source, source_size, greatest(least(cap, coalesce(common * w, cap)), 0.0) AS target FROM m
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS epochs FROM t
), p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  size * (epochs + CASE WHEN rest > 0 AND upto - rest <= rest - (upto - size) THEN 1 ELSE 0 END)::BIGINT AS taken
FROM p
"""
