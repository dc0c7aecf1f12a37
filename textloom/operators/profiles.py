"""Profiles of payloads and texts: marks, declarations, names, ranges, letters, noise counts.

What looks at each character of each text runs on Arrow batches over the property arrays that detection uses, without a
loop over characters, and returns counts; all else is Spark's own expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import batches as B
from ..functions import characters as C
from ..functions import coherence as K
from ..functions import mess as M
from ..functions import tables as T

#: Code points that classes cover: all planes with letters.
LAST = 0x30000


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bom_encoding(payload: Column | str) -> Column:
    """The encoding a byte-order mark at the beginning stands for, null if none."""
    begin = F.hex(F.substring(_col(payload), 1, 4))
    out = F.lit(None).cast("string")
    for name, mark in reversed(T.MARKS):
        out = F.when(begin.startswith(mark.hex().upper()), F.lit(name)).otherwise(out)
    return out


def encoding_name(label: Column | str) -> Column:
    """The encoding that a label stands for, null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in sorted(T.names().items()) for x in pair))
    return F.try_element_at(table, F.regexp_replace(F.lower(_col(label)), "-", "_"))


def declared_encoding(payload: Column | str, zone: int = T.DECLARATION_ZONE) -> Column:
    """The first known encoding that the ASCII part of the beginning of a binary payload names."""
    # each byte as one character, those beyond ASCII dropped
    text = F.regexp_replace(F.decode(F.substring(_col(payload), 1, zone), "ISO-8859-1"), r"[\x80-\xff]+", "")
    labels = F.regexp_extract_all(text, F.lit("(?i)" + T.DECLARATION), F.lit(1))
    known = F.filter(F.transform(labels, encoding_name), lambda x: x.isNotNull())
    low = F.lower(text)
    # without either word there is no declaration: most payloads end here
    return F.when(low.contains("coding") | low.contains("charset"), F.get(known, F.lit(0)))


def is_valid_utf8(payload: Column | str) -> Column:
    return F.is_valid_utf8(_col(payload))


def is_ascii(payload: Column | str) -> Column:
    """Whether a binary payload is ASCII: valid UTF-8 with a character for each byte."""
    return F.when(F.is_valid_utf8(_col(payload)), F.octet_length(_col(payload)) == F.char_length(_col(payload).cast("string"))).otherwise(False)


def multi_byte_usage(text: Column | str) -> Column:
    """The share of bytes of a UTF-8 text beyond one for each character; 0 for an empty text."""
    size = F.octet_length(_col(text))
    return F.when(size > 0, 1 - F.char_length(_col(text)) / size).otherwise(0.0)


@cache
def character_class(bits: int, without: int = 0) -> str:
    """A regular expression's class of the characters with all of ``bits`` and none of ``without``."""
    p = C.properties(np.arange(LAST, dtype=np.int64))
    hit = ((p & bits) == bits) & ((p & without) == 0)
    hit[0xD800:0xE000] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return "[" + "".join(f"\\x{{{a:X}}}" if b - a == 1 else f"\\x{{{a:X}}}-\\x{{{b - 1:X}}}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)) + "]"


#: Counts that noise detectors are ratios of: the bits that a character has, and those that it hasn't.
COUNTS = {
    "n_chars": (0, 0),
    "n_unprintable": (C.UNPRINTABLE, 0),
    "n_alpha": (C.ALPHA, 0),
    "n_accentuated": (C.ALPHA | C.ACCENT, 0),
    "n_cjk": (C.ALPHA | C.CJK, 0),
    "n_cjk_uncommon": (C.ALPHA | C.CJK, C.COMMON),
    "n_arabic": (C.ALPHA | C.ARABIC, 0),
    "n_arabic_isolated": (C.ALPHA | C.ISOLATED, 0),
    "n_katakana": (C.ALPHA | C.KATAKANA, 0),
    "n_katakana_halfwidth": (C.ALPHA | C.HALFWIDTH, 0),
    "n_printable": (C.PRINTABLE, 0),
    "n_punctuation": (C.PUNCTUATION, 0),
    "n_symbols": (C.SYMBOL, 0),
}


def counts_of(text: Column | str, counts: dict[str, tuple[int, int]]) -> Column:
    """A struct with the number of characters of each kind; null for a null text."""

    def of(texts: pa.Array) -> pa.Array:
        parts = [[np.zeros(0, np.int64)] for _ in counts]
        for _, _, codes, first in B.code_points(texts):
            p = C.properties(codes)
            for part, (bits, without) in zip(parts, counts.values(), strict=True):
                part.append(B.per_text(((p & bits) == bits) & ((p & without) == 0), first))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in parts], names=list(counts), mask=texts.is_null())

    @F.arrow_udf("struct<" + ",".join(f"{n}:bigint" for n in counts) + ">")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, texts)

    return counted(_col(text))


def noise_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """With the counts that noise detectors are ratios of, and n_escape."""
    counted = df.withColumn("_n", counts_of(text, COUNTS))
    return counted.select(*df.columns, *(F.col(f"_n.{n}").alias(n) for n in COUNTS), F.regexp_count(_col(text), F.lit(r"\x1B")).cast("long").alias("n_escape"))


def accent_pairs(text: Column | str) -> Column:
    """Detector 4's count: of Latin letters one after the other (others left out), accented pairs that are both upper,
    plus those that have one base."""

    def of(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0, np.int64)]
        for low, high, codes, first in B.code_points(texts):
            p = C.properties(codes)
            letter = np.flatnonzero((p & (C.ALPHA | C.LATIN)) == C.ALPHA | C.LATIN)
            p, base, doc = p[letter], C.bases(codes[letter]), np.repeat(np.arange(high - low), np.diff(first))[letter]
            both = p[1:] & p[:-1]
            pair = (doc[1:] == doc[:-1]) & (both & C.ACCENT > 0)
            n = pair * ((both & C.UPPER > 0).astype(np.int64) + (base[1:] == base[:-1]))
            out.append(np.bincount(doc[1:], weights=n, minlength=high - low).astype(np.int64))
        return pa.array(np.concatenate(out), mask=texts.is_null().to_numpy(zero_copy_only=False))

    @F.arrow_udf("bigint")
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, texts)

    return counted(_col(text))


@cache
def _base_map() -> tuple[str, str]:
    p = C.properties(np.arange(LAST, dtype=np.int64))
    codes = np.flatnonzero((p & (C.ACCENT | C.LATIN | C.ALPHA)) == C.ACCENT | C.LATIN | C.ALPHA)
    return "".join(map(chr, codes.tolist())), "".join(map(chr, C.bases(codes).tolist()))


def characters(df: DataFrame, by: list[str], text: str = "text", bits: int = 0, order: str | None = None) -> DataFrame:
    """How often each character with ``bits`` is in the texts of each group: (by..., character, n); with ``order``, a
    long of the rows (nulls last), also first: where it is met first, (order, place). Counted within each batch, so
    what moves is as many rows as a batch has distinct characters."""
    rank = [] if order is None else [F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)).alias("_order")]
    own = df.select(*by, _col(text).alias("_text"), *rank)
    types = dict(own.dtypes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            b = whole if order is None else whole.take(pc.sort_indices(whole.column(len(by) + 1)))
            groups: dict[str, int] = {}
            keys = zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True) if by else ((),) * b.num_rows
            of = np.array([groups.setdefault(str(k), len(groups)) for k in keys], np.int64)
            rows = np.unique(of, return_index=True)[1]
            for low, high, codes, first in B.code_points(b.column(len(by))):
                doc = np.repeat(np.arange(low, high), np.diff(first))
                keep = (C.properties(codes) & bits) == bits
                kept, own_doc = codes[keep], doc[keep]
                found, at, n = np.unique(of[own_doc] * 0x110000 + kept, return_index=True, return_counts=True)
                group, code = found // 0x110000, found % 0x110000
                columns = [*(b.column(i).take(pa.array(rows[group])) for i in range(len(by))), pa.array([chr(c) for c in code.tolist()], pa.string()), pa.array(n, pa.int64())]
                names = [*by, "character", "n"]
                if order is not None:
                    place = np.flatnonzero(keep)[at] - first[own_doc[at] - low]
                    columns += [b.column(len(by) + 1).take(pa.array(own_doc[at])), pa.array(place, pa.int64())]
                    names += ["_order", "_place"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "character string", "n bigint", *(["_order bigint", "_place bigint"] if order else [])])
    each = own.mapInArrow(counted, schema)
    return each.groupBy(*by, "character").agg(F.sum("n").alias("n"), *([F.min(F.struct("_order", "_place")).alias("first")] if order else []))


def each_of(text: Column | str, of: Callable[[np.ndarray, np.ndarray, int], float], kind: str = "bigint") -> Column:
    """A number for each text, from its code points, their properties, and how many they are; null for a null text."""

    def numbers(texts: pa.Array) -> pa.Array:
        out = []
        for _, _, codes, first in B.code_points(texts):
            p = C.properties(codes)
            out += [of(codes[a:b], p[a:b], b - a) if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.array(out, mask=texts.is_null().to_numpy(zero_copy_only=False)).cast(pa.int64() if kind == "bigint" else pa.float64())

    @F.arrow_udf(kind)
    def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(numbers, texts)

    return counted(_col(text))


def mark_weights(text: Column | str) -> Column:
    """Detector 1's count: punctuation once, symbols twice, unless safe or a repeat of the printable one before."""
    return each_of(text, lambda codes, p, n: int(M.mark_weights(codes, p, n)[-1]))


def range_pairs(text: Column | str) -> Column:
    """Detector 5's count: printable neighbours of ranges that don't go together."""
    return each_of(text, lambda codes, p, n: int(M.range_pairs(codes, p, n)[-1]))


#: Of single characters, what is told by their properties.
KINDS = {"is_alpha": C.ALPHA, "is_upper": C.UPPER, "is_lower": C.LOWER, "is_digit": C.DIGIT, "is_space": C.SPACE, "is_ascii": C.ASCII, "is_punctuation": C.PUNCTUATION, "is_symbol": C.SYMBOL, "is_case_variable": C.CASED, "is_unprintable": C.UNPRINTABLE, "is_cjk": C.CJK, "is_katakana": C.KATAKANA, "is_hiragana": C.HIRAGANA, "is_hangul": C.HANGUL, "is_thai": C.THAI, "is_arabic": C.ARABIC, "is_latin": C.LATIN}


def character_kinds(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., character, n, base, one flag for each of KINDS): the characters of each group's texts. Properties are
    looked up for distinct characters alone."""

    def of(letters: pa.Array) -> pa.Array:
        codes = np.fromiter(map(ord, letters.to_pylist()), np.int64, len(letters))
        p = C.properties(codes)
        columns = [pa.array(list(map(chr, C.bases(codes).tolist())), pa.string()), *(pa.array((p & b) > 0) for b in KINDS.values())]
        return pa.StructArray.from_arrays(columns, names=["base", *KINDS])

    @F.arrow_udf("struct<base:string," + ",".join(f"{k}:boolean" for k in KINDS) + ">")
    def kinds(letters: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, letters)

    return characters(df, by, text).withColumn("_k", kinds(F.col("character"))).select(*by, "character", "n", "_k.*")


def ranges_table(spark) -> DataFrame:
    """Fixed size: the Unicode ranges with family and whether they are secondary."""
    return spark.createDataFrame([(n, a, b, T.family(n), T.is_secondary(n)) for n, a, b in T.bounds()], "range string, start int, stop int, family string, secondary boolean")


def range_histogram(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """(by..., range, family, n_chars, n_distinct): characters by Unicode range. Ranges are looked up for distinct
    characters alone."""
    counted = characters(df, by, text).withColumn("cp", F.ascii("character"))
    ranges = F.broadcast(ranges_table(df.sparkSession))  # some hundred rows, whatever the data
    joined = counted.join(ranges, (F.col("cp") >= F.col("start")) & (F.col("cp") < F.col("stop")))
    return joined.groupBy(*by, "range", "family").agg(F.sum("n").alias("n_chars"), F.count(F.lit(1)).alias("n_distinct"))


def letter_ranks(df: DataFrame, by: list[str], text: str = "text", order: str = "doc_id") -> DataFrame:
    """(by..., letter, n, rank): letters by frequency in each group, the first first; of equal ones that which is met
    first, texts being read by ``order``."""
    from pyspark.sql import Window as W

    counted = characters(df.withColumn("_lower", F.lower(text)), by, "_lower", C.ALPHA, order)
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("n"), "first", "character")))
    return ranked.select(*by, F.col("character").alias("letter"), "n", "rank")


def popularity(ranks: DataFrame, by: list[str]) -> DataFrame:
    """From (by..., letter, n, rank) of :func:`letter_ranks`: (by..., language, n_agreeing, n_letters), how many letters
    have a place that agrees with the language's, for every language. A group has one row for each letter, so it is
    gathered in one; texts are not."""
    ordered = ranks.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "letter"))), lambda x: x["letter"]).alias("_letters"))

    def of(letters: pa.Array) -> pa.Array:
        rows = [[{"language": k, "n_agreeing": n} for k, n in K.all_agreeing(x).items()] for x in letters.to_pylist()]
        return pa.array(rows, pa.list_(pa.struct([("language", pa.string()), ("n_agreeing", pa.int64())])))

    @F.arrow_udf("array<struct<language:string,n_agreeing:bigint>>")
    def agreeing(letters: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, letters)

    each = ordered.withColumn("n_letters", F.size("_letters").cast("long")).select(*by, "n_letters", F.explode(agreeing(F.col("_letters"))).alias("x"))
    return each.select(*by, "x.language", "x.n_agreeing", "n_letters")


def alphabet_coverage(df: DataFrame, keys: list[str], text: str = "text", least: float = 0.2) -> DataFrame:
    """(keys..., language, n_shared, n_alphabet): languages of which at least a share of the alphabet is in the text."""
    names = list(T.LANGUAGES)
    size = np.array([len(v) for v in T.LANGUAGES.values()])
    letters = sorted(set("".join(T.LANGUAGES.values())))
    known, holds = np.array([ord(c) for c in letters]), np.array([[c in v for v in T.LANGUAGES.values()] for c in letters])

    def of(texts: pa.Array) -> pa.Array:
        rows: list[list[dict]] = []
        for low, high, codes, first in B.code_points(texts):
            doc = np.repeat(np.arange(high - low), np.diff(first))
            met = np.unique(doc * 0x110000 + codes)
            met = met[np.isin(met % 0x110000, known)]
            shared = np.zeros((high - low, len(names)), np.int64)
            np.add.at(shared, met // 0x110000, holds[np.searchsorted(known, met % 0x110000)])
            enough = shared >= least * size
            rows += [[{"language": names[k], "n_shared": int(own[k]), "n_alphabet": int(size[k])} for k in np.flatnonzero(ok)] for own, ok in zip(shared, enough, strict=True)]
        return pa.array(rows, pa.list_(pa.struct([("language", pa.string()), ("n_shared", pa.int64()), ("n_alphabet", pa.int64())])))

    @F.arrow_udf("array<struct<language:string,n_shared:bigint,n_alphabet:bigint>>")
    def covered(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from map(of, texts)

    each = df.select(*keys, F.explode(covered(F.lower(_col(text)))).alias("x"))
    return each.select(*keys, "x.language", "x.n_shared", "x.n_alphabet")


def merge_coherence(df: DataFrame, by: list[str]) -> DataFrame:
    """From (by..., language, ratio): the mean ratio of each language, alternative profiles apart."""
    return df.groupBy(*by, "language").agg(F.avg("ratio").alias("ratio"))


def fold_alternatives(df: DataFrame, by: list[str]) -> DataFrame:
    """From (by..., language, ratio): alternative profiles as their language with the best ratio; a group in which no
    language is there twice stays as it is."""
    from pyspark.sql import Window as W

    base = df.withColumn("_base", F.regexp_replace("language", "—", "")).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*by, "_base")))
    twice = base.withColumn("_any", F.max("_n").over(W.partitionBy(*by)) > 1)
    name = F.when(F.col("_any"), F.col("_base")).otherwise(F.col("language"))
    return twice.groupBy(*by, name.alias("language")).agg(F.max("ratio").alias("ratio"))


def code_pages(spark) -> DataFrame:
    """Fixed size: (encoding, byte, character) of the single-byte encodings; a null character is undefined."""
    rows = [(e, b, c) for e in T.candidates() if not T.is_multi_byte(e) for b, c in enumerate(T.code_page(e))]
    return spark.createDataFrame(rows, "encoding string, byte int, character string")


def code_page_similarity(pages: DataFrame) -> DataFrame:
    """(a, b, similarity): the share of bytes that two code pages (encoding, byte, character) decode alike."""
    a, b = pages.select(F.col("encoding").alias("a"), "byte", F.col("character").alias("x")), pages.select(F.col("encoding").alias("b"), "byte", F.col("character").alias("y"))
    pairs = a.join(b, "byte").where("a <> b")
    return pairs.groupBy("a", "b").agg((F.sum(F.col("x").eqNullSafe(F.col("y")).cast("int")) / F.count(F.lit(1))).alias("similarity"))


def fold_submatches(df: DataFrame, keys: list[str]) -> DataFrame:
    """From (keys..., ordinal, encoding, chaos, text): matches of equal noise and text as one, under the encoding that
    was tried first, with could_be_from in order of trial. Texts are told apart by their SHA-256, so they don't move."""
    tried = F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "encoding"))), lambda x: x["encoding"])
    folded = df.groupBy(*keys, "chaos", F.unhex(F.sha2("text", 256)).alias("_digest")).agg(tried.alias("could_be_from"), F.min("ordinal").alias("ordinal"))
    return folded.select(*keys, "ordinal", F.get("could_be_from", F.lit(0)).alias("encoding"), "chaos", "could_be_from")
