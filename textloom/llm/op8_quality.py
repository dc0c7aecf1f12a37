"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base rules come first: fewer than 50 words, or more than half of the words under repeated 3-word windows, fail. Of the
others, five transformed statistics make a vector: log of the number of words, characters a word, and the square roots
of symbols a character, repeated lines a line, and repeated words a word. For each language and source the minimum
covariance determinant is estimated: concentration steps each take the half of the documents nearest to the last estimate
and estimate mean and covariance again, until no group's determinant falls by more than LEAST_FALL, STEPS at most. There
are two starts, which less than half of a group can't carry off: the shortest half of each statistic, and medians with
median deviations; the smaller determinant decides. Random starts are left out on purpose: a block of a third of copies and
the few documents nearest to it can have the least determinant of all halves, and a start inside it would find that. Of
documents as far as the edge of the half, all count by the part that fills it, so a block of copies doesn't enter whole. A
document over CUTOFF in squared Mahalanobis distance (for the normal law, one clean document in a million) is rejected.

FLOORS are the least standard deviations a statistic is taken to have (a group whose documents hold no symbol at all has
variance zero). They are a third or less of what the least event makes: one repeated line of ten is 0.32 in v_lines, one
repeated window of fifty words 0.35 in v_repeats. So one event is no reason to reject, while 40 % of repeated lines are,
in a group without any; length alone decides beyond a factor of e^3. Vectors are kept as integers of a thousandth, so
all sums are exact and reruns agree. Quantiles are read from histograms, whose size doesn't grow with the input; every
aggregate is summed before the shuffle, so one large group is no single task's work.

Groups of fewer than LEAST documents are pooled, as half of them are too few for the twenty numbers of an estimate; if
the pool is as small, its documents are kept. Null lang and source
are groups of their own. Null and empty texts have no words and fail the base rules. Repeated rows count each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import Scope

SPACES = " \t\n\x0b\x0c\r"
STEPS, SHARE, LEAST = 12, 0.5, 50
#: Half the logarithm of a determinant has to fall by so much, a tenth of a percent of one standard deviation.
LEAST_FALL = 1e-3
#: The chi-squared quantile of five degrees that a clean document exceeds with this probability.
TAIL = 1e-6
#: Parts of a distribution, in which its shortest half is looked for.
PARTS = 32
UNIT = 1000
FLOORS = {"v_words": 0.5, "v_length": 0.4, "v_symbols": 0.03, "v_lines": 0.1, "v_repeats": 0.1}
NAMES = list(FLOORS)


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words in place of text."""
    others = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = docs.select(*others, words_of(F.col("text")).alias("w"), lines.alias("l"), F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).alias("s"))
    d = d.select(
        *others, "w", F.size("w").alias("n"), F.length(F.array_join("w", "")).alias("c"), "s", F.size("l").alias("nl"), (F.size("l") - F.size(F.array_distinct("l"))).alias("dl"),
        F.when(F.size("w") > 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))).alias("g"),
    )
    # only a text with two equal hashes can have a repeated window: the rest have none, without a sort
    some = F.coalesce(F.size(F.array_distinct("g")) < F.size("g"), F.lit(False))
    # hash above, place below, in one sorted array of longs: places whose hash is met twice are neighbours
    low = F.when(F.col("n") < 1 << 20, 20).otherwise(32)
    d = d.withColumn("b", low).withColumn("p", F.when(some, F.expr("sort_array(transform(g, (x, i) -> shiftleft(shiftright(x, b), b) + i))")))
    same = F.expr("filter(p, (x, i) -> (i > 0 and shiftright(x, b) = shiftright(get(p, i - 1), b)) or shiftright(x, b) = shiftright(get(p, i + 1), b))")
    at = F.expr("transform(q, x -> cast(x - shiftleft(shiftright(x, b), b) as int))")
    d = d.withColumn("q", same).withColumn("q", at)
    # and the words themselves decide
    d = d.withColumn("k", F.expr("array_sort(transform(q, i -> struct(concat_ws(' ', get(w, i), get(w, i + 1), get(w, i + 2)) as k, i as i)))"))
    d = d.withColumn("r", F.expr("sort_array(transform(filter(k, (x, i) -> (i > 0 and x.k = get(k, i - 1).k) or coalesce(x.k = get(k, i + 1).k, false)), x -> x.i))"))
    repeats = F.expr("aggregate(transform(r, (x, i) -> least(3, coalesce(get(r, i + 1) - x, 3))), 0L, (a, x) -> a + x)")
    return d.select(*others, *(F.col(a).cast("long").alias(b) for a, b in (("n", "n_words"), ("c", "word_chars"), ("s", "n_symbols"), ("nl", "n_lines"), ("dl", "n_dup_lines"))), F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    n = F.greatest("n_words", F.lit(1))
    of = (
        F.log(F.col("n_words") + 1.0),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return [F.round(x * UNIT).cast("long").alias(name) for x, name in zip(of, NAMES, strict=True)]


def _reached(counts: DataFrame, group: list[str], value: str) -> DataFrame:
    """``counts`` with upto, the sum of n up to its ``value``, and all, the group's. It is a histogram: as many rows as
    there are values, however large the group."""
    up = W.partitionBy(*group).orderBy(value)
    return counts.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy(*group)))


def _starts(long: DataFrame) -> DataFrame:
    """From (group, i, v, n): the two starts of each group, named by #0 or #1 after it."""
    marks = _reached(long, ["group", "i"], "v").groupBy("group", "i").agg(F.array(*(F.min(F.when(F.col("upto") * PARTS >= F.col("all") * p, F.col("v"))) for p in range(PARTS + 1))).alias("q"))
    halves = F.expr(f"array_min(transform(sequence(0, {PARTS - PARTS // 2}), p -> struct(q[p + {PARTS // 2}] - q[p] as wide, (q[p + {PARTS // 2}] + q[p]) / 2 as mid)))")
    marks = marks.select("group", "i", halves.alias("h"), F.col("q")[PARTS // 2].alias("median"))
    apart = long.join(marks.select("group", "i", "median"), ["group", "i"]).groupBy("group", "i", F.abs(F.col("v") - F.col("median")).alias("v")).agg(F.sum("n").alias("n"))
    apart = _reached(apart, ["group", "i"], "v").where(F.col("upto") * 2 >= F.col("all")).groupBy("group", "i").agg(F.min("v").alias("apart"))
    each = marks.join(apart, ["group", "i"])
    each = each.select(F.concat("group", F.lit("#0")).alias("group"), "i", F.col("h.mid").cast("double").alias("m"), (F.col("h.wide") / 1.349).alias("sd")).unionByName(each.select(F.concat("group", F.lit("#1")).alias("group"), "i", F.col("median").cast("double").alias("m"), (F.col("apart") * 1.4826).alias("sd")))
    k = len(NAMES)
    floor = [F.lit((FLOORS[x] * UNIT) ** 2) for x in NAMES]
    start = each.groupBy("group").agg(*(F.max(F.when(F.col("i") == i, F.col("m"))).alias(f"m_{i}") for i in range(k)), *(F.greatest(F.max(F.when(F.col("i") == i, F.col("sd") * F.col("sd"))), floor[i]).alias(f"c_{i}{i}") for i in range(k)))
    return _factored(start.withColumns({f"c_{i}{j}": F.lit(0.0) for i in range(k) for j in range(i)}))


def _nearest(placed: DataFrame) -> DataFrame:
    """n, sums s_i and products p_ij of the nearest SHARE of each group's vectors (of n rows each)."""
    k = len(NAMES)
    reached = _reached(placed.groupBy("group", "bin").agg(F.sum("n").alias("n")), ["group"], "bin").where(F.col("upto") >= SHARE * F.col("all"))
    edge = reached.groupBy("group").agg(F.min(F.struct("bin", (1 - (F.col("upto") - SHARE * F.col("all")) / F.col("n")).alias("part"))).alias("e")).select("group", F.col("e.bin").alias("edge"), "e.part")

    def total(x: Column) -> Column:  # whole numbers are summed, so the order of rows doesn't matter
        return F.coalesce(F.sum(F.when(F.col("bin") < F.col("edge"), F.col("n") * x)), F.lit(0)) + F.max("part") * F.coalesce(F.sum(F.when(F.col("bin") == F.col("edge"), F.col("n") * x)), F.lit(0))

    near = placed.join(edge, "group").where("bin <= edge")
    return near.groupBy("group").agg(total(F.lit(1)).alias("n"), *(total(F.col(x)).alias(f"s_{i}") for i, x in enumerate(NAMES)), *(total(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"p_{i}{j}") for i in range(k) for j in range(i + 1)))


def _chi2_share(p: int, x: float) -> float:
    """The share of a chi-squared law of p degrees below x, by Simpson's rule over the square root."""
    n, top = 2000, math.sqrt(x)
    f = [2 * (i * top / n) ** (p - 1) * math.exp(-((i * top / n) ** 2) / 2) / (2 ** (p / 2) * math.gamma(p / 2)) for i in range(n + 1)]
    return top / n / 3 * (f[0] + f[-1] + 4 * sum(f[1:-1:2]) + 2 * sum(f[2:-1:2]))


def _chi2_quantile(p: int, share: float) -> float:
    low, high = 0.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_share(p, mid) < share else (low, mid)
    return low


def consistency(p: int, share: float) -> float:
    """By how much the covariance of the nearest ``share`` of normal vectors is too small."""
    return share / _chi2_share(p + 2, _chi2_quantile(p, share))


CUTOFF = _chi2_quantile(len(NAMES), 1 - TAIL)


def _estimate(sums: DataFrame, scale: float) -> DataFrame:
    """From n, sums s_i and products p_ij: means m_i and the Cholesky factor l_ij of the covariance, with floors."""
    k = len(NAMES)
    n = F.col("n").cast("double")
    out = sums.select("group", "n", *((F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(k)), *(f"p_{i}{j}" for i in range(k) for j in range(i + 1)))
    cov = {(i, j): (F.col(f"p_{i}{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}")) * scale for i in range(k) for j in range(i + 1)}
    out = out.select("group", "n", *(f"m_{i}" for i in range(k)), *((F.greatest(c, F.lit((FLOORS[NAMES[i]] * UNIT) ** 2)) if i == j else c).alias(f"c_{i}{j}") for (i, j), c in cov.items()))
    return _factored(out)


def _factored(out: DataFrame) -> DataFrame:
    """With l_ij of c_ij, column by column. A pivot is at least a hundredth of its variance."""
    k = len(NAMES)
    for j in range(k):
        pivot = F.col(f"c_{j}{j}") - sum((F.col(f"l_{j}{x}") * F.col(f"l_{j}{x}") for x in range(j)), F.lit(0.0))
        out = out.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(pivot, F.col(f"c_{j}{j}") * 0.01)))
        for i in range(j + 1, k):
            rest = F.col(f"c_{i}{j}") - sum((F.col(f"l_{i}{x}") * F.col(f"l_{j}{x}") for x in range(j)), F.lit(0.0))
            out = out.withColumn(f"l_{i}{j}", rest / F.col(f"l_{j}{j}"))
    return out.select("group", *(f"m_{i}" for i in range(k)), *(f"l_{i}{j}" for i in range(k) for j in range(i + 1)))


def _distances(vectors: DataFrame, estimates: DataFrame) -> DataFrame:
    """``vectors`` with d2, the squared Mahalanobis distance from their group's estimate; null without one."""
    d = vectors.join(estimates, "group", "left")
    for i, name in enumerate(NAMES):
        gone = sum((F.col(f"l_{i}{j}") * F.col(f"y_{j}") for j in range(i)), F.lit(0.0))
        d = d.withColumn(f"y_{i}", (F.col(name) - F.col(f"m_{i}") - gone) / F.col(f"l_{i}{i}"))
    return d.select(*vectors.columns, sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(NAMES))), F.lit(0.0)).alias("d2"))


def _bin(d2: Column) -> Column:
    return F.floor(F.log(d2 + 1.0) * 64)


def estimated(s: Scope, vectors: DataFrame) -> DataFrame:
    """From (group, the NAMES as whole numbers, n rows that have them): the minimum covariance determinant of each group,
    as means m_i and Cholesky factor l_ij."""
    k = len(NAMES)
    long = s.table(vectors.select("group", "n", F.posexplode(F.array(*NAMES)).alias("i", "v")).groupBy("group", "i", "v").agg(F.sum("n").alias("n")))
    estimates = s.table(_starts(long))
    both = vectors.withColumn("group", F.explode(F.array(*(F.concat("group", F.lit(x)) for x in ("#0", "#1")))))
    size = sum((F.log(f"l_{i}{i}") for i in range(k)), F.lit(0.0))
    values = [f"m_{i}" for i in range(k)] + [f"l_{i}{j}" for i in range(k) for j in range(i + 1)] + ["size"]
    for step in range(STEPS):
        placed = _distances(both, estimates).withColumn("bin", _bin(F.col("d2")))
        new = _estimate(_nearest(placed), consistency(k, SHARE)).withColumn("size", size)
        if not step:  # the start is no group's half, so its determinant says nothing
            estimates = s.table(new)
            continue
        # a group keeps its estimate unless the determinant falls
        old = estimates.select("group", *(F.col(c).alias(f"old_{c}") for c in values))
        fell = F.col("size") < F.col("old_size") - LEAST_FALL
        estimates = s.table(new.join(old, "group").select("group", *(F.when(fell, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in values), fell.alias("fell")))
        if estimates.where("fell").isEmpty():
            break
    best = estimates.groupBy(F.expr("substring(group, 1, length(group) - 2)").alias("group")).agg(F.min(F.struct("size", *values[:-1])).alias("best"))
    return best.select("group", *(f"best.{c}" for c in values[:-1]))


def judged(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, source): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept; and d2, the squared distance, null where the base rules decide."""
    with Scope(docs.sparkSession) as s:
        base = base_statistics(docs.select("doc_id", "lang", "source", "text"))
        key = F.struct(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("lang"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"))
        stats = s.table(base.select(F.col("doc_id").cast("long").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), F.to_json(key).alias("own"), *_vector()))
        sizes = stats.where("not base_failed").groupBy("own").agg(F.count(F.lit(1)).alias("size"))
        pooled = s.table(sizes.select("own", F.when(F.col("size") >= LEAST, F.col("own")).otherwise("").alias("group")))
        vectors = s.table(stats.where("not base_failed").join(pooled, "own").groupBy("group", *NAMES).agg(F.count(F.lit(1)).alias("n")))
        large = vectors.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST).select("group")
        estimates = estimated(s, vectors.join(large, "group"))
        grouped = stats.join(pooled, "own", "left").withColumn("group", F.when(~F.col("base_failed"), F.col("group")))
        far = _distances(grouped, estimates)
        return s.keep(far.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUTOFF)).alias("kept"), "d2"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")).drop("d2")
