"""Mixing sources to target weights by a low-discrepancy schedule
(DataFrame functions only).

Every source gets a share of the corpus size by its weight, stopped at
``cap`` times its own size; the excess is shared again by weight.  The
documents of a source, in a shuffled order, form a run of words cut into
blocks of ``block_words`` words.  The van der Corput points 0, 1/2, 1/4,
3/4, ... are mapped through the cumulative weights; the k-th point that
falls to a source takes the source's k-th block, starting over after the
last.  A source's last block is cut at the words still due, so every source
gets its target rounded to whole words.  The rank of a point among its source's is computed from its binary
digits, so no task ever orders a whole source.

Cases: null text has size 0, documents of size 0 are never taken; a null
source is a source of its own, last in order; repeated rows are separate
documents; an empty table gives no rows.  Results depend on rows and seed
only, so reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import prefix_sums, shuffle_parts, word_count, written

BUCKET_BITS = 12          # a source's documents are ordered within 2**12 hash buckets
CHUNK = 4096              # points made from one row


@dataclass
class Mix:
    """sources: source, source_size, weight, target, n_blocks, n_slots, rest (words of the last slot);
    schedule: slot (place in the mix), source, epoch, block, most (words taken of the block at most);
    docs: doc_id, source, size, key, place (first word in the source's run);
    pieces: docs with size > 0 cut at blocks: block, start (in the document), words, inside (start in the block)."""

    sources: DataFrame
    schedule: DataFrame
    docs: DataFrame
    pieces: DataFrame


def shares(docs: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """Weights and targets of the sources (one row per source)."""
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = prefix_sums(by.withColumn("one", F.lit(1)), [F.col("source").asc_nulls_last()], {"place": "one"}, "mixrank")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    ranked = ranked.select("source", "place", "source_size", w.alias("weight"), (F.col("source_size") * cap).alias("most"))
    filled = prefix_sums(ranked, [F.col("most") / F.col("weight"), F.col("place")], {"most_before": "most", "weight_before": "weight"}, "mixfill")
    total, weight = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, weight = total or 0, weight or 1
    # In order of most / weight, a source stops at its cap if an equal share of what is left would exceed it.
    rest = (F.lit(float(total)) - F.col("most_before")) / (F.lit(weight) - F.col("weight_before"))
    filled = written(filled.withColumn("stops", F.col("most") / F.col("weight") < rest), "mixstops")
    taken, used = filled.where("stops").agg(F.sum("most"), F.sum("weight")).first()
    per = (total - (taken or 0)) / max(1, weight - (used or 0))
    return filled.select("source", "place", "source_size", "weight",
                         F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.least(F.col("weight") * F.lit(float(per)), F.col("most").cast("double"))).alias("target"))


def _reverse_bits(x: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of x in reverse order."""
    for mask, n in ((0x5555555555555555, 1), (0x3333333333333333, 2), (0x0F0F0F0F0F0F0F0F, 4),
                    (0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16), (0x00000000FFFFFFFF, 32)):
        m = F.lit(mask)
        x = F.shiftleft(x.bitwiseAND(m), n).bitwiseOR(F.shiftrightunsigned(x, n).bitwiseAND(m))
    return F.shiftrightunsigned(x, 64 - bits)


def _rank_expr(bits: int) -> str:
    """Among the points before the one whose reversed index is j, how many
    have a reversed index in [lo, hi).  For each binary digit that is set in
    the point's index, the points that first differ there have reversed
    indices c, c + step, c + 2 step, ...: their number below a bound is a
    division."""
    def below(x: str) -> str:
        return f"least(greatest(({x} - c.c + c.step - 1) div c.step, 0L), c.n)"
    return (f"aggregate(transform(filter(sequence(0, {bits - 1}), b -> shiftright(j, {bits - 1} - b) & 1L = 1L), "
            f"b -> named_struct('c', j & (shiftleft(1L, {bits - 1} - b) - 1L), 'step', shiftleft(1L, {bits} - b), 'n', shiftleft(1L, b))), "
            f"0L, (a, c) -> a + {below('hi')} - {below('lo')})")


def schedule(sources: DataFrame, block_words: int) -> DataFrame:
    """The slots of all sources: slot, source, epoch, block, most."""
    spans = prefix_sums(sources.where("n_slots > 0"), [F.col("place")], {"lo": "n_slots"}, "mixspans")
    total = spans.agg(F.max(F.col("lo") + F.col("n_slots"))).first()[0] or 1
    bits = max(1, int(total - 1).bit_length())
    chunks = (spans.withColumn("hi", F.col("lo") + F.col("n_slots"))
              .withColumn("from", F.explode(F.expr(f"sequence(lo, hi - 1, {CHUNK}L)")))
              .repartition(shuffle_parts(sources.sparkSession), "from"))
    slots = (chunks.withColumn("j", F.explode(F.expr(f"sequence(from, least(from + {CHUNK}L, hi) - 1)")))
             .withColumn("rank", F.expr(_rank_expr(bits))))
    return slots.select(_reverse_bits(F.col("j"), bits).alias("slot"), "source",
                        F.expr("rank div n_blocks").alias("epoch"), F.expr("rank % n_blocks").alias("block"),
                        F.expr(f"if(rank = n_slots - 1, rest, {block_words}L)").alias("most"))


def mix(docs: DataFrame, *, weights=(5, 2, 1), cap: int = 3, block_words: int = 64, seed: int = 17) -> Mix:
    rows = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                               F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key")), "mixdocs")
    sources = shares(rows, weights, cap)
    blocks = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    # Whole passes, then blocks up to the words still due, the last of them cut.
    due = F.least(F.round("target").cast("long"), F.col("source_size") * cap)
    sources = (sources.withColumn("n_blocks", blocks).withColumn("due", F.when(F.col("source_size") > 0, due).otherwise(F.lit(0).cast("long")))
               .withColumn("over", F.expr("if(source_size > 0, due % source_size, 0L)")))
    slots = F.expr(f"if(source_size > 0, due div source_size, 0L) * n_blocks + (over + {block_words - 1}) div {block_words}")
    rest = F.expr(f"if(over > 0, (over - 1) % {block_words} + 1, {block_words}L)")
    sources = written(sources.withColumn("n_slots", slots).withColumn("rest", rest).drop("due", "over"), "mixsources")
    # Places: totals per hash bucket, running over a source's 2**BUCKET_BITS buckets, then inside each bucket.
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    over = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
              .withColumn("place", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .select("doc_id", "source", "size", "key", "place"))
    placed = written(placed, "mixplaced")
    n = block_words
    pieces = (placed.where("size > 0")
              .withColumn("block", F.explode(F.expr(f"sequence(place div {n}, (place + size - 1) div {n})")))
              .withColumn("start", F.greatest(F.col("block") * n - F.col("place"), F.lit(0)))
              .withColumn("words", F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * n) - F.col("place") - F.col("start"))
              .withColumn("inside", F.col("place") + F.col("start") - F.col("block") * n))
    # Written, as an estimate of its size from the few rows it is made of would have it broadcast.
    return Mix(sources, written(schedule(sources, block_words), "mixslots"), placed, pieces)


def _words() -> Column:
    """Words of a piece that a slot of its block takes."""
    return F.least(F.col("words"), F.greatest(F.col("most") - F.col("inside"), F.lit(0)))


def mixed_stream(m: Mix) -> DataFrame:
    """The mix itself: slot, source, epoch, and the words [start, start +
    words) of the documents in each slot's block (order by slot, place)."""
    p = m.pieces.withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    return (m.schedule.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
            .select("slot", "source", "epoch", "doc_id", "place", "start", _words().alias("words")).where("words > 0"))


def taken(m: Mix) -> DataFrame:
    """Per document, the words that the mix takes of it, repeats counted."""
    uses = m.schedule.groupBy("source", "block", "most").agg(F.count("*").alias("uses"))
    uses = uses.select(F.col("source").alias("s"), F.col("block").alias("b"), "most", "uses")
    got = (m.pieces.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
           .groupBy("source", "place").agg(F.sum(_words() * F.col("uses")).alias("taken")))
    got = got.select(F.col("source").alias("s"), F.col("place").alias("p"), "taken")
    out = m.docs.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")) & (F.col("size") > 0), "left")
    return out.select("doc_id", "source", "size", "key", "place", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_sizes(docs: DataFrame, **params) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document."""
    m = mix(docs, **params)
    s = m.sources.select(F.col("source").alias("s"), "source_size", "target")
    return (taken(m).join(s, F.col("source").eqNullSafe(F.col("s")))
            .select("doc_id", "source", "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The documents as often as the mix takes them, all columns.  A document
    that it takes whole k times and w words more gives k rows, and one with
    its first w words, joined by blanks."""
    names = docs.columns
    seed = params.get("seed", 17)
    own = Window.partitionBy("doc_id", "source", "key").orderBy("place")
    got = (taken(mix(docs, **params)).withColumn("n", F.row_number().over(own)).where("taken > 0")
           .select(*[F.col(c).alias(f"_tw_{c}") for c in ("doc_id", "source", "key", "n")],
                   F.expr("taken div size").alias("_tw_whole"), F.expr("cast(taken % size as int)").alias("_tw_rest")))
    got = written(got, "mixtaken")
    # Rows with one id, source and text are interchangeable: the n-th here is the n-th there.
    same = Window.partitionBy("doc_id", "source", "_tw_hash").orderBy(F.lit(0))
    rows = docs.withColumn("_tw_hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).withColumn("_tw_nth", F.row_number().over(same))
    both = rows.join(got, F.col("doc_id").eqNullSafe(F.col("_tw_doc_id")) & F.col("source").eqNullSafe(F.col("_tw_source"))
                     & (F.col("_tw_hash") == F.col("_tw_key")) & (F.col("_tw_nth") == F.col("_tw_n")))
    turns = both.withColumn("_tw_turn", F.explode(F.expr("sequence(1L, _tw_whole + if(_tw_rest > 0, 1L, 0L))")))
    part = F.array_join(F.slice(F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+"), 1, F.col("_tw_rest")), " ")
    text = F.when(F.col("_tw_turn") > F.col("_tw_whole"), part).otherwise(F.col("text"))
    turns = turns.withColumn("text", text)
    if "n_chars" in names:
        turns = turns.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return turns.select(*names)
