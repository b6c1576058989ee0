"""SimHash document fingerprints and Hamming-radius search, in DataFrame functions only.

A term is three consecutive words; its 64 + 64 hash bits vote with the term's weight, for a set
bit and against a clear one. Votes are summed two bits to a long (32 bits each), so that one
hash aggregate with 64 sums yields all 128 counts and only one row per text is shuffled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BITS = 128
TERM_WORDS = 3
#: Ranges of ids, each one window group: at least so many, and eight to a shuffle partition, so that groups do
#: not grow with the data. Their bounds are two text literals in the plan, however many they are.
ID_RANGES = 1024
#: Bits within which block tables find fingerprints: copies with a word or two changed.
CLOSE_BITS = 3
#: Bits by which near copies differ: of 1,513 texts of sf0.1 with random words replaced, of a 5-word Jaccard
#: of 0.8 or more, 99.87 % differ by no more; of 79,792 pairs of unlike texts the nearest differ by 38.
NEAR_BITS = 24
#: Distinct fingerprints that are broadcast at once to meet all others.
ASKED_BROADCAST = 400_000
_PAIR = 0x0000000100000001
_SEEDS = (0, 1)


def _terms(text: Column) -> Column:
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.arrays_zip(*[(w if i == 0 else F.slice(w, i + 1, F.size(w))).alias(f"w{i}") for i in range(TERM_WORDS)])


def fingerprint_texts(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys`` and the two longs fp_hi, fp_lo of each key's text.

    ``keys`` identify a row and are not null. A null text counts as empty; an empty text has the
    single term of one empty word, so all empty texts are equal. A term weighs one plus the
    number of its words of over three bytes.
    """
    rows = texts.select(*keys, F.explode(_terms(F.col(text_col))).alias("t"))
    cols = [F.col(f"t.w{i}") for i in range(TERM_WORDS)]
    long_words = [F.when(F.octet_length(c) > 3, F.lit(1)).otherwise(F.lit(0)) for c in cols]
    weight = (F.lit(1) + long_words[0] + long_words[1] + long_words[2]).cast("long")
    rows = rows.select(*keys, weight.alias("wt"), *[F.xxhash64(F.lit(s), *cols).alias(f"h{s}") for s in _SEEDS])
    votes = [F.sum(F.shiftright(F.col(f"h{s}"), j).bitwiseAND(F.lit(_PAIR)) * F.col("wt")).alias(f"v{s}_{j}") for s in _SEEDS for j in range(32)]
    sums = rows.groupBy(*keys).agg(F.sum("wt").alias("total"), *votes)

    def gather(s: int) -> Column:
        bits = []
        for j in range(32):
            v = F.col(f"v{s}_{j}")
            for at, ones in ((j, v.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(v, 32))):
                mask = 1 << at
                bits.append(F.when(ones * 2 > F.col("total"), F.lit(mask if at < 63 else mask - 2**64)).otherwise(F.lit(0)).cast("long"))
        while len(bits) > 1:
            bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
        return bits[0]

    return sums.select(*keys, gather(0).alias("fp_hi"), gather(1).alias("fp_lo"))


def distance(a_hi, a_lo, b_hi, b_lo) -> Column:
    return F.bit_count(F.col(a_hi).bitwiseXOR(F.col(b_hi))) + F.bit_count(F.col(a_lo).bitwiseXOR(F.col(b_lo)))


def hex_string(hi, lo) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.col(c)), 16, "0")) for c in (hi, lo)])


def _id_bounds(ids: DataFrame, ranges: int) -> list[int]:
    """About ``ranges`` ids in order, those of the least hashes, and the largest; without any id 0."""
    n, top = ids.agg(F.count("doc_id"), F.max("doc_id")).first()
    h = F.xxhash64(F.lit("bounds"), F.col("doc_id")).bitwiseAND(F.lit((1 << 63) - 1))
    some = ids.where((h <= min((1 << 63) - 1, (1 << 63) * ranges // max(n, 1))) | (F.col("doc_id") == F.lit(top)))
    return some.where("doc_id is not null").agg(F.array_sort(F.collect_set("doc_id"))).first()[0] or [0]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """rng, rn, ghost, doc_id, text, next_text; next in descending doc_id, the first after the last.

    Ids are cut into ranges at ids that occur, so each range is one window group of bounded size. The
    head of every range is copied, as a ghost, to the end of the range before it, which makes ``lead``
    right at the borders without any global sort. Ghosts stay in the result so that callers can look
    ahead once more. Rows without doc_id, and rows of one doc_id, are in one range each.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = ranges or max(ID_RANGES, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _id_bounds(src.select("doc_id"), ranges)
    top, step, doc_id = len(bounds) - 1, max(1, round(len(bounds) ** 0.5)), F.col("doc_id")
    cut = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    heads = F.split(F.lit(",".join(str(c[-1]) for c in cut)), ",").cast("array<long>")
    blocks = F.split(F.lit(";".join(",".join(map(str, c)) for c in cut)), ";")
    block = lambda i: F.split(F.get(blocks, i), ",").cast("array<long>")
    # the first bound that is not below the id, in two steps of about sqrt(n)
    at = F.size(F.filter(heads, lambda b: b < doc_id))
    within = F.size(F.filter(F.coalesce(block(at), F.array().cast("array<long>")), lambda b: b < doc_id))
    rng = F.when(doc_id.isNull(), F.lit(0)).otherwise(at * step + within)
    head = doc_id.isNotNull() & F.get(block(F.floor(F.col("rng") / step).cast("int")), F.col("rng") % step).eqNullSafe(doc_id)
    alone = doc_id.isNull() & F.lit(src.where("doc_id is not null").isEmpty())
    here = F.struct(F.col("rng"), F.lit(0).alias("ghost"))
    before = F.struct(F.when(F.col("rng") == top, 0).otherwise(F.col("rng") + 1).alias("rng"), F.lit(1).alias("ghost"))
    places = F.when(head | alone, F.array(here, before)).otherwise(F.array(here))
    rows = src.withColumn("rng", rng).select("doc_id", "text", F.explode(places).alias("p")).select("p.rng", "p.ghost", "doc_id", "text")
    order = Window.partitionBy("rng").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return rows.select("rng", F.row_number().over(order).alias("rn"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last ``n_chars div 2`` code points replaced by as many first ones (or
    all) of the next document's. Returns doc_id, n_chars, edited_sha256, fp_hi, fp_lo,
    edited_hi, edited_lo, near_edited, near_next. Null texts count as empty. Rows with one doc_id
    follow each other in order of their texts; rows without a doc_id come last. A lone document
    is its own next. An empty table gives an empty result. Other columns are ignored.
    """
    rows = with_next(docs).withColumns({"text": F.coalesce("text", F.lit("")), "next_text": F.coalesce("next_text", F.lit(""))})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("body")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("body")))
    both = F.when(F.col("ghost") == 1, F.slice(both, 1, 1)).otherwise(both)
    texts = rows.select("rng", "rn", "ghost", F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "n_chars", "edited_sha256", F.explode(both).alias("b"))
    texts = texts.select("rng", "rn", "ghost", "id", "no_id", "n_chars", "edited_sha256", "b.v", "b.body")
    fps = fingerprint_texts(texts, ["rng", "rn", "ghost", "id", "no_id", "n_chars", "edited_sha256", "v"], "body")
    order = Window.partitionBy("rng").orderBy("rn", "v")
    ahead = F.when(F.col("v") == 0, F.lead("fp_hi", 1).over(order)), F.when(F.col("v") == 0, F.lead("fp_lo", 1).over(order))
    beyond = F.lead("fp_hi", 2).over(order), F.lead("fp_lo", 2).over(order)  # two rows on: the next document's own
    fps = fps.select("*", ahead[0].alias("edited_hi"), ahead[1].alias("edited_lo"), beyond[0].alias("next_hi"), beyond[1].alias("next_lo")).where("v = 0 and ghost = 0")
    likeness = lambda hi, lo: F.lit(1.0) - distance("fp_hi", "fp_lo", hi, lo) / F.lit(float(BITS))
    return fps.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_chars", "edited_sha256", "fp_hi", "fp_lo", "edited_hi", "edited_lo",
        likeness("edited_hi", "edited_lo").alias("near_edited"), likeness("next_hi", "next_lo").alias("near_next"),
    )


def _block_keys(hi: str, lo: str, radius: int, extra: int) -> Column:
    """(table, key) of every block table: blocks of the 128 bits, ``extra`` of them equal in each."""
    n = radius + extra
    cuts = [BITS * i // n for i in range(n + 1)]
    text = F.concat(*[F.lpad(F.bin(F.col(c)), 64, "0") for c in (hi, lo)])
    block = [F.substring(text, a + 1, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[block[i] for i in chosen]).alias("key")) for t, chosen in enumerate(combinations(range(n), extra))])


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = 3, extra: int = 2) -> DataFrame:
    """Pairs of distinct fingerprints within ``radius`` bits: q_hi, q_lo, fp_hi, fp_lo, distance, copies.

    Both inputs have fp_hi and fp_lo. The 128 bits are cut into ``radius + extra`` blocks; two
    fingerprints within the radius agree in at least ``extra`` whole blocks, and there is one
    table for each choice of ``extra`` blocks, keyed by them. So all pairs are found, exactly.
    Equal fingerprints are one row with their number of ``copies`` before any join.
    """
    distinct = fingerprints.groupBy("fp_hi", "fp_lo").agg(F.count(F.lit(1)).alias("copies"))
    asked = queries.select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo")).distinct()
    tables = distinct.select("*", F.explode(_block_keys("fp_hi", "fp_lo", radius, extra)).alias("b")).select("fp_hi", "fp_lo", "copies", "b.table", "b.key")
    keys = asked.select("*", F.explode(_block_keys("q_hi", "q_lo", radius, extra)).alias("b")).select("q_hi", "q_lo", "b.table", "b.key")
    met = tables.join(keys.hint("merge"), ["table", "key"]).withColumn("distance", distance("fp_hi", "fp_lo", "q_hi", "q_lo"))
    return met.where(F.col("distance") <= radius).select("q_hi", "q_lo", "fp_hi", "fp_lo", "distance", "copies").distinct()


def within_any_radius(fingerprints: DataFrame, queries: DataFrame, radius: int, at_once: int = ASKED_BROADCAST) -> DataFrame:
    """As ``within_radius``, for a radius at which block tables are too coarse: each query meets all.

    The distinct queries are broadcast, in slices by a hash of about ``at_once``, and compared with
    every distinct fingerprint. So all pairs are found, exactly, by as many comparisons as there are pairs.
    """
    spark = fingerprints.sparkSession
    parts = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # dealt by number, since the work is in the comparisons and not in the few bytes
    distinct = fingerprints.groupBy("fp_hi", "fp_lo").agg(F.count(F.lit(1)).alias("copies")).repartition(parts)
    asked = queries.select(F.col("fp_hi").alias("q_hi"), F.col("fp_lo").alias("q_lo")).distinct()
    slices = max(1, -(-asked.count() // at_once))
    apart = distance("q_hi", "q_lo", "fp_hi", "fp_lo")
    found = None
    for i in range(slices):
        some = asked if slices == 1 else asked.where(F.pmod(F.xxhash64("q_hi", "q_lo"), F.lit(slices)) == i)
        met = distinct.join(F.broadcast(some), apart <= radius).select("q_hi", "q_lo", "fp_hi", "fp_lo", apart.alias("distance"), "copies")
        found = met if found is None else found.union(met)
    return found


def near_counts(fingerprints: DataFrame, every: int = 50, close: int = CLOSE_BITS, radius: int = NEAR_BITS) -> DataFrame:
    """doc_id, fp_hi, fp_lo, n_close, n_within: for each id divisible by ``every``, other documents within ``close``
    and ``radius`` bits; one row for each id and fingerprint.

    Block tables find what is close. At the wide radius their keys would be a few bits, and each query meets all.
    """
    queries = fingerprints.where(F.col("doc_id") % every == 0)
    count = lambda found, name: found.groupBy("q_hi", "q_lo").agg((F.sum("copies") - 1).alias(name))
    near = count(within_radius(fingerprints, queries, close), "n_close").join(count(within_any_radius(fingerprints, queries, radius), "n_within").hint("merge"), ["q_hi", "q_lo"])
    asked = queries.select("doc_id", "fp_hi", "fp_lo").distinct()
    return asked.join(near.withColumnsRenamed({"q_hi": "fp_hi", "q_lo": "fp_lo"}).hint("merge"), ["fp_hi", "fp_lo"])


def op5(docs: DataFrame) -> DataFrame:
    """``fingerprint_documents`` as hex strings, with the numbers of ``near_counts`` for its queries, else null."""
    fps = materialize(fingerprint_documents(docs), "simhash")
    near = materialize(near_counts(fps.where(F.col("doc_id").isNotNull())), "simhash-near")
    return fps.join(near.hint("merge"), ["doc_id", "fp_hi", "fp_lo"], "left").select(
        "doc_id", "n_chars", "edited_sha256", hex_string("fp_hi", "fp_lo").alias("fingerprint"), hex_string("edited_hi", "edited_lo").alias("edited_fingerprint"),
        "near_edited", "near_next", F.col("n_close").alias("n_close"), F.col("n_within").alias("n_within_radius"),
    )
