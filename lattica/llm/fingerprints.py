"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import documents, in_order, materialize, words

SHINGLE = 5
K = 256
#: Bits of a hash in a sketch.
BITS = 48
#: Up to so many sorted partitions their first rows are broadcast; beyond, joined.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Distinct 48-bit hashes of the word shingles of a text in lower case; of fewer words, one of the whole sequence.
    Null and texts without words have none."""
    word_hashes = F.transform(words(F.lower(text)), lambda x: F.xxhash64(x))

    def hashes(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(h, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *(F.get(h, i + j) for j in range(1, shingle))), 64 - BITS))
        whole = F.slice(many, 1, F.greatest(n - shingle + 1, F.lit(1)))  # without those that the end cuts short
        return F.when(n > 0, F.array_distinct(whole)).otherwise(F.array().cast("array<bigint>"))

    # One binding of the hashes, or each use would cut the text again.
    return F.get(F.transform(F.array(word_hashes), hashes), F.lit(0))


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The k least hashes of a text's shingles, in order."""
    return F.slice(F.sort_array(shingle_hashes(text, shingle)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th least hash as a fraction."""
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / (F.element_at(s, -1) / float(1 << BITS)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold. Two empty sketches: 1."""
    # Least of the union that both hold. One binding of the union, or each use would make it again.
    share = lambda m: F.size(F.array_intersect(F.array_intersect(a, b), m)) / F.size(m)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.get(F.transform(F.array(merge(a, b, k)), share), F.lit(0)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too; of an empty a: 1."""
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(common / distinct_count(a, k), F.lit(1.0)))


def packed(s: Column) -> Column:
    """A sketch as bytes: 6 for each hash, big-endian."""
    return F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), ""))


def unpacked(raw: Column) -> Column:
    """The inverse of packed."""
    n = BITS // 4

    def whole(digits: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / n - 1, F.lit(0)).cast("int")), lambda i: F.conv(F.substr(digits, i * n + 1, F.lit(n)), 16, 10).cast("long"))

    return F.when(F.length(raw) > 0, F.get(F.transform(F.array(F.hex(raw)), whole), F.lit(0))).otherwise(F.array().cast("array<bigint>"))


def encoded(s: Column) -> Column:
    """A sketch as text: base64 of its bytes."""
    return F.base64(packed(s))


def decoded(s: Column) -> Column:
    """The inverse of encoded."""
    return unpacked(F.unbase64(s))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """docs (doc_id, text) with the sketch of each text: doc_id, sketch, n_distinct. Null texts and texts without words have
    empty sketches; repeated rows and null ids give a row each, an empty table none; other columns are ignored."""
    return docs.select("doc_id", sketch(F.col("text"), k).alias("sketch")).withColumn("n_distinct", distinct_count(F.col("sketch"), k))


def merged(parts: DataFrame, key: str, k: int = K) -> DataFrame:
    """Sketches of the groups of parts (key, sketch). Their hashes are made distinct before they are gathered, and a
    group's array of them is cut to k, group by group of partitions, so that no group gathers all its parts. A null key is a
    group; groups of empty sketches alone have no row."""
    salted = parts.select(key, F.pmod(F.xxhash64("sketch"), F.lit(64)).alias("_salt"), F.explode("sketch").alias("_h")).distinct()
    least = Window.partitionBy(key, "_salt").orderBy("_h")
    salted = salted.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= k)
    return salted.groupBy(key).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias("sketch"))


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def following(docs: DataFrame) -> DataFrame:
    """For each of docs (doc_id, text) the next one in descending doc_id (nulls last), the first after the last: doc_id,
    row_key, n_chars, next_key, times. Only ids, keys and lengths are sorted; partitions' first rows close the gaps between
    partitions. Rows with equal doc_id and text are one in the order, and all but the last of them are followed by the
    same text: a row with their number less one as times."""
    ids = docs.groupBy("doc_id", _row_key().alias("row_key"), F.length("text").alias("n_chars")).agg(F.count(F.lit(1)).alias("n"))
    line = in_order(ids, F.col("doc_id").desc_nulls_last(), F.col("row_key"), name="fingerprint-order")
    firsts = line.where("idx = 0").select("pid", "row_key")
    cyclic = F.coalesce(F.lead("row_key").over(Window.orderBy("pid")), F.first("row_key").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = materialize(firsts.select("pid", cyclic.alias("after")), "fingerprint-firsts")
    line = line.withColumn("inner", F.lead("row_key").over(Window.partitionBy("pid").orderBy("idx")))
    line = line.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts, "pid")
    step = lambda key, times: F.struct(key.alias("next_key"), times.cast("long").alias("times"))
    steps = F.filter(F.array(step(F.coalesce("inner", "after"), F.lit(1)), step(F.col("row_key"), F.col("n") - 1)), lambda x: x["times"] > 0)
    return materialize(line.select("doc_id", "row_key", "n_chars", F.inline(steps)), "fingerprint-next")


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every text's fingerprint, that of its edited text, and their likeness.

    Two joins: texts by their key with the document before them, for which they give their first code points and their
    sketch; those by key with the documents' texts. Both use one exchange of the texts. Null texts are empty; an empty
    fingerprint is like another empty one. Repeated rows follow each other and give a row each; an empty table none.
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    links = following(docs)
    texts = docs.withColumn("row_key", _row_key())
    repeated = not links.where("times > 1 OR row_key = next_key").isEmpty()
    if repeated:
        texts = texts.dropDuplicates(["row_key"])
    wanted = links.select(F.col("next_key").alias("row_key"), F.col("row_key").alias("for_key"), F.floor(F.col("n_chars") / 3).cast("int").alias("take"), "times")
    lent = texts.join(wanted, "row_key")
    # next_doc_id keeps both sides' columns, and so their exchange, the same.
    lent = lent.select("for_key", "take", "times", F.col("doc_id").alias("next_doc_id"), F.substr("text", F.lit(1), F.col("take")).alias("lent"), sketch(F.col("text")).alias("other"))
    pairs = texts.join(lent.withColumnRenamed("for_key", "row_key"), "row_key")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("take")), F.col("lent"))
    pairs = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), sketch(F.col("text")).alias("own"), edited.alias("edited"), "other", "next_doc_id", "times")
    pairs = pairs.select("doc_id", "n_chars", "own", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("edited")).alias("changed"), "other", "next_doc_id", "times")
    found = pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        encoded(F.col("own")).alias("fingerprint"),
        encoded(F.col("changed")).alias("edited_fingerprint"),
        resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        resemblance(F.col("own"), F.col("other")).alias("near_next"),
        "next_doc_id",
        "times",
    )
    return (found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))) if repeated else found).drop("times")
