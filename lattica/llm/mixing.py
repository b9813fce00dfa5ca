"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import WORD, in_order, materialize, n_words

#: Multipliers of the block permutations: primes above any number of blocks, so that each is coprime to it.
PRIMES = (1_000_003, 1_299_709, 15_485_863, 32_452_843, 49_979_687, 67_867_967, 86_028_121, 104_395_301)

#: Draws the left child's number x of source K's blocks: n slots are left to fill from N blocks, of which K are this
#: source's. Inverse hypergeometric distribution function within 10 standard deviations of the mean (less than 1e-20
#: lies outside), with weights by the ratio of neighbouring probabilities.
_DRAW = """
transform(array(named_struct('lo', greatest(0L, s.n - (s.total - k.q)), 'hi', least(s.n, k.q),
    'mean', s.n * (k.q / greatest(s.total, 1L)),
    'sd', sqrt(greatest(0D, s.n * (k.q / greatest(s.total, 1L)) * (1 - k.q / greatest(s.total, 1L)) * (s.total - s.n) / greatest(s.total - 1, 1L))),
    'u', shiftrightunsigned(xxhash64({seed}L, node, k.ix), 11) / 9007199254740992D)), r ->
  transform(array(named_struct('lo', greatest(r.lo, least(r.hi, cast(floor(r.mean - 10 * r.sd - 1) AS BIGINT))),
      'hi', least(r.hi, greatest(r.lo, cast(ceil(r.mean + 10 * r.sd + 1) AS BIGINT))))), w ->
    aggregate(sequence(w.lo, w.hi),
      named_struct('w', 1D, 'pick', w.lo, 'rest', r.u * aggregate(sequence(w.lo, w.hi), named_struct('w', 1D, 'sum', 0D),
          (a, x) -> named_struct('w', a.w * (k.q - x) * (s.n - x) / ((x + 1D) * greatest(1D, s.total - k.q - s.n + x + 1D)), 'sum', a.sum + a.w), a -> a.sum)),
      (a, x) -> named_struct('w', a.w * (k.q - x) * (s.n - x) / ((x + 1D) * greatest(1D, s.total - k.q - s.n + x + 1D)),
        'pick', if(a.rest > 0, x, a.pick), 'rest', a.rest - a.w), a -> a.pick))[0])[0]
"""

#: One node's quotas split: the left child gets half the slots.
_SPLIT = """
aggregate(quotas,
  named_struct('total', aggregate(quotas, 0L, (a, k) -> a + k.q), 'n', aggregate(quotas, 0L, (a, k) -> a + k.q) div 2,
    'out', cast(array() AS ARRAY<STRUCT<ix: BIGINT, q: BIGINT, x: BIGINT>>)),
  (s, k) -> transform(array({draw}), x -> named_struct('total', s.total - k.q, 'n', s.n - x,
    'out', concat(s.out, array(named_struct('ix', k.ix, 'q', k.q, 'x', x)))))[0],
  s -> s.out)
"""


def source_targets(sizes: DataFrame, max_repeat: int = 3, blocks: int = 2048, min_block: int = 32) -> DataFrame:
    """One row a source of (source, size): its rank by code point (null last), weight 1, 2, 3, repeating, target
    in words, n_blocks, and quota in blocks.

    Water filling in closed form: in order of cap over weight, the level (what is left) / (weight that is left) rises up
    to the first source that its cap doesn't bind and falls after it, so the level sought is the largest. The table has
    a row a source, small beside the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    by_rank = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("ix", F.row_number().over(by_rank).cast("long") - 1)
    per = per.withColumns({"weight": F.col("ix") % 3 + 1, "cap": F.col("source_size") * float(max_repeat)})
    before = Window.orderBy(F.col("cap") / F.col("weight"), "ix").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    per = per.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    small = F.ceil(F.col("source_size") / 64)
    block = F.greatest(F.ceil(F.col("source_size") / blocks), F.least(F.lit(min_block), small), F.lit(1))
    per = per.withColumn("n_blocks", F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.when(F.col("source_size") > 0, (F.col("target") - passes * F.col("source_size")) / F.col("source_size") * F.col("n_blocks")).otherwise(0)
    return per.withColumn("quota", (passes * F.col("n_blocks") + F.round(rest)).cast("long")).drop("cap", "level")


def shard_bounds(targets: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """ix -> bounds: ends, in the source's stream of permuted blocks, of the run that each shard draws. The tree starts
    from one row with all quotas, and each level halves every node's slots by hypergeometric draws, so the shards'
    quotas add up to the sources' exactly."""
    node = targets.agg(F.sort_array(F.collect_list(F.struct("ix", F.col("quota").alias("q")))).alias("quotas")).select(F.lit(0).cast("long").alias("node"), "quotas")
    split = _SPLIT.format(draw=_DRAW.format(seed=seed))
    for _ in range(max(n_shards - 1, 0).bit_length()):
        node = node.withColumn("split", F.expr(split)).select(
            F.explode(
                F.expr(
                    "array(named_struct('node', node * 2, 'quotas', transform(split, k -> named_struct('ix', k.ix, 'q', k.x))),"
                    " named_struct('node', node * 2 + 1, 'quotas', transform(split, k -> named_struct('ix', k.ix, 'q', k.q - k.x))))"
                )
            ).alias("c")
        ).select("c.node", "c.quotas")
    runs = node.select("node", F.explode("quotas").alias("k")).select("node", "k.ix", "k.q")
    runs = runs.withColumn("end", F.sum("q").over(Window.partitionBy("ix").orderBy("node").rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("ix").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("bounds"))


def mix(docs: DataFrame, n_shards: int = 16, max_repeat: int = 3, blocks: int = 2048, min_block: int = 32, seed: int = 20_24) -> DataFrame:
    """The mix of docs (doc_id, text, source): a row a document with doc_id, source, size, source_size, target and
    pieces: array of (shard, epoch, place, start, len) in words. place is a random place for the local shuffle of a shard.

    A source's documents lie in random order on a line of words that even blocks cut; epoch by epoch the blocks are
    permuted, and each shard draws the next run of them, as long as the splitting tree says; what no shard draws isn't
    taken. n_shards is a power of two.

    Nulls: a null or empty text has size 0 and no piece; a null source is a source of its own, ranked last. Repeated rows
    are documents of their own. An empty table gives an empty mix. Other columns are ignored.
    """
    sizes = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    targets = source_targets(sizes, max_repeat, blocks, min_block)
    plan = materialize(targets.join(shard_bounds(targets, n_shards, seed), "ix"), "mix-plan")

    line = in_order(sizes, F.col("source"), F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"), name="mix-line")
    local = Window.partitionBy("pid", "source").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    parts = line.groupBy("pid", "source").agg(F.sum("size").alias("words"))
    bases = parts.select("pid", "source", (F.sum("words").over(Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("base"))
    line = line.withColumn("at", F.sum("size").over(local) - F.col("size")).alias("d")
    bases, plan = bases.alias("b"), plan.alias("p")
    line = line.join(bases, F.expr("d.pid = b.pid AND d.source <=> b.source")).join(plan, F.expr("d.source <=> p.source"))
    line = line.select("d.doc_id", "d.source", "d.size", (F.col("d.at") + F.col("b.base")).alias("at"), "p.source_size", "p.target", "p.n_blocks", "p.quota", "p.ix", "p.bounds")
    primes = ", ".join(f"{p}L" for p in PRIMES)
    pieces = f"""
      flatten(transform(if(size > 0, sequence(((at + 1) * n_blocks - 1) div source_size, ((at + size) * n_blocks - 1) div source_size), cast(array() AS ARRAY<BIGINT>)), b ->
        filter(transform(sequence(0L, (element_at(bounds, -1) - 1) div n_blocks), e -> named_struct(
            'epoch', e,
            'rank', e * n_blocks + pmod(b * element_at(array({primes}), cast(pmod(xxhash64({seed}L, ix, e), {len(PRIMES)}L) AS INT) + 1) + pmod(xxhash64({seed + 1}L, ix, e), n_blocks), n_blocks),
            'start', greatest(at, (b * source_size) div n_blocks) - at,
            'len', least(at + size, ((b + 1) * source_size) div n_blocks) - greatest(at, (b * source_size) div n_blocks))),
          x -> x.rank < element_at(bounds, -1) AND x.len > 0)))"""
    placed = """transform(pieces, x -> named_struct('shard', size(filter(bounds, v -> v <= x.rank)), 'epoch', x.epoch,
        'place', xxhash64(doc_id, x.rank), 'start', x.start, 'len', x.len))"""
    pieces_of = line.withColumn("pieces", F.when((F.col("size") > 0) & (F.element_at("bounds", -1) > 0), F.expr(pieces)))
    return pieces_of.select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.expr(placed), F.array().cast("array<struct<shard:int,epoch:bigint,place:bigint,start:bigint,len:bigint>>")).alias("pieces"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, with docs' columns: a row for each run of words that a shard takes of a document in an
    epoch, in order of shards and, within a shard, of place; a large shard goes on over several partitions. text is that
    run with its own white space; n_chars, if there, is its length. The other columns are the document's, whatever their
    names. Null and empty texts give no row, an empty table none; repeated rows are documents of their own."""
    number, runs_of, run, words_of = (f"{x}_{uuid.uuid4().hex}" for x in ("k", "runs", "run", "size"))
    plan = mix(docs, **options).select("doc_id", "pieces")
    # Equal rows are interchangeable: each takes one of the plans for its id.
    plan = plan.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.size("pieces"), F.xxhash64(F.to_json(F.struct("pieces"))))))
    size = n_words(F.col("text"))
    rows = docs.withColumn(number, F.row_number().over(Window.partitionBy("doc_id").orderBy(size)))
    # Neighbouring pieces of an epoch that one shard draws join to one run, at the place of its first.
    runs = """aggregate(array_sort(transform(pieces, x -> named_struct('shard', x.shard, 'epoch', x.epoch, 'start', x.start, 'len', x.len, 'place', x.place))),
        cast(array() AS ARRAY<STRUCT<shard: INT, epoch: BIGINT, start: BIGINT, len: BIGINT, place: BIGINT>>),
        (a, x) -> if(size(a) > 0 AND element_at(a, -1).shard = x.shard AND element_at(a, -1).epoch = x.epoch AND element_at(a, -1).start + element_at(a, -1).len = x.start,
            concat(slice(a, 1, size(a) - 1), array(named_struct('shard', x.shard, 'epoch', x.epoch, 'start', element_at(a, -1).start, 'len', element_at(a, -1).len + x.len, 'place', element_at(a, -1).place))),
            concat(a, array(x))))"""
    plan = plan.withColumn(runs_of, F.expr(runs)).where(F.size(runs_of) > 0).drop("pieces")
    joined = rows.alias("d").join(plan.alias("p"), F.expr(f"d.doc_id <=> p.doc_id AND d.{number} = p.{number}")).select("d.*", f"p.{runs_of}")
    # A text is cut into words once, whatever the number of its runs.
    spaced = F.regexp_extract_all("text", F.lit(rf"({WORD}[\x20\x09-\x0D]*)"), F.lit(1))
    part = lambda words, r: F.when(r["len"] == F.col(words_of), F.col("text")).otherwise(F.array_join(F.slice(words, r["start"] + 1, r["len"]), ""))
    cut = F.transform(F.array(spaced), lambda words: F.transform(runs_of, lambda r: F.struct(r.alias("run"), part(words, r).alias("text"))))
    joined = joined.withColumn(words_of, size).withColumn(run, F.explode(cut[0]))
    out = joined.withColumn("text", F.col(f"{run}.text")).withColumn(run, F.col(f"{run}.run"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.orderBy(f"{run}.shard", f"{run}.place", "doc_id", f"{run}.epoch", f"{run}.start").select(*(f"`{c}`" for c in docs.columns))


def by_shard(pieces: str, n_shards: int = 16) -> Column:
    """Words that each shard takes."""
    return F.expr(f"transform(sequence(0, {n_shards - 1}), s -> aggregate(filter({pieces}, x -> x.shard = s), 0L, (a, x) -> a + x.len))")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    """What the shards of the mix hold of every document: taken is the sum over the shards' words. Nulls, repeated rows and
    empty tables: see mix."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    mixed = mixed.select("doc_id", "size", "source_size", "target", F.size("pieces").alias("n_pieces"), by_shard("pieces").alias("taken_by_shard"))
    taken = F.aggregate("taken_by_shard", F.lit(0).cast("long"), lambda a, x: a + x)
    return mixed.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "n_pieces", "taken_by_shard")
