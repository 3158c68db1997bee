"""Mixing sources to target weights, with DataFrame functions only.

Hash-threshold histograms: word counts are summed by source and leading hash
bits, the bucket in which a source's budget ends is found from running sums, and
only the rows of that bucket are looked at with more bits. A row is taken by
comparing its hash with its source's threshold, so no rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, numbered

#: Hash bits in all, and those that each histogram looks at.
HASH_BITS, STEP_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column) -> Column:
    """A hash of HASH_BITS bits. Rows that repeat an id share it, and so are taken together."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds `target` to one row per source (source, source_size).

    Sources in code-point order, null last, take the weights in turn. A target
    stops at `cap` times its source's size. Sources are filled in the order of
    cap over weight: one is capped if the level that the rest would get lies
    above its own, which gives the same split as sharing the excess again and
    again. There is one row per source, so windows over all of them are small.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(1))
    pick = F.array(*[F.lit(float(w)) for w in weights])
    t = totals.withColumn("rank", F.row_number().over(named) - 1)
    t = t.withColumn("weight", F.element_at(pick, (F.col("rank") % len(weights) + 1).cast("int")))
    t = t.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("fills_at", F.col("most") / F.col("weight"))
    before = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
    t = t.withColumn("all_weight", F.sum("weight").over(everything))
    t = t.withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    t = t.withColumn("capped", F.col("level") > F.col("fills_at"))
    spent = F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * (F.col("budget") - spent) / free)
    return t.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source: whole copies of each row, and the hash below which a row is taken once more.

    Each round narrows a source's open interval of hashes to the one bucket in
    which its budget ends; running sums see 2**STEP_BITS rows per source at most.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    bounds = targets.withColumn("copies", ratio).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = scratch.save(bounds.withColumn("low", F.lit(0).cast("long")).withColumn("open", F.lit(True)), "bounds-0")
    for step in range(1, HASH_BITS // STEP_BITS + 1):
        width = 1 << (HASH_BITS - STEP_BITS * step)
        b = bounds.select(F.col("source").alias("b_source"), F.col("low").alias("b_low")).filter("open")
        inside = sized.join(b, sized.source.eqNullSafe(b.b_source))
        inside = inside.filter((F.col("hash") >= F.col("b_low")) & (F.col("hash") < F.col("b_low") + (width << STEP_BITS)))
        histogram = inside.groupBy("b_source", ((F.col("hash") - F.col("b_low")) / width).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("b_source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = histogram.withColumn("upto", F.sum("words").over(upto))
        key = bounds.source.eqNullSafe(running.b_source)
        crossed = running.join(bounds, key).filter(F.col("upto") > F.col("left")).groupBy("b_source").agg(F.min(F.struct("bucket", "words", "upto")).alias("at"))
        hit = F.col("at").isNotNull()
        low = F.when(hit, F.col("low") + F.col("at.bucket") * width).when(F.col("open"), F.col("low") + (width << STEP_BITS)).otherwise(F.col("low"))
        left = F.when(hit, F.col("left") - (F.col("at.upto") - F.col("at.words"))).otherwise(F.col("left"))
        if width == 1:  # the rows of one hash: take them if that comes nearer
            low = low + F.when(hit & (left * 2 > F.col("at.words")), F.lit(1)).otherwise(F.lit(0))
        bounds = bounds.join(crossed, F.col("source").eqNullSafe(F.col("b_source")), "left")
        bounds = scratch.save(bounds.select("source", "source_size", "target", "copies", left.alias("left"), low.cast("long").alias("low"), hit.alias("open")), f"bounds-{step}")
        scratch.drop(f"bounds-{step - 1}")
    return bounds


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    taken is the document's words times the copies that the mix holds of it.
    Null text has size 0, and texts of any length count whole; null is a source of its own; an empty table gives no
    rows; rows that repeat a doc_id are taken alike; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("hash")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = thresholds(sized, source_targets(totals, weights, share, cap), scratch)
    found = found.select(F.col("source").alias("t_source"), "source_size", "target", "copies", "low")
    taken = F.col("size") * (F.col("copies") + (F.col("hash") < F.col("low")).cast("long"))
    joined = sized.join(found, F.col("source").eqNullSafe(F.col("t_source")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The documents of the mix themselves, each as often as the mix takes it, with their own columns, whatever these are named.

    Documents without words weigh nothing and stay once. Null is a source of its
    own; rows that repeat an id are taken alike; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    own, name = numbered(docs)
    id_, source, text = (F.col(name[c]) for c in ("doc_id", "source", "text"))
    sized = scratch.save(own.select(source.alias("source"), word_count(text).alias("size"), id_hash(id_).alias("hash")), "sized")
    found = thresholds(sized, source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), scratch)
    found = found.select(F.col("source").alias("t_source"), "copies", "low")
    copies = F.col("copies") + (id_hash(id_) < F.col("low")).cast("long")
    copies = F.when(F.regexp_like(F.coalesce(text, F.lit("")), F.lit(WORD)), copies).otherwise(F.lit(1))
    joined = own.join(found, source.eqNullSafe(F.col("t_source"))).withColumn("times", copies.cast("int")).filter("times > 0")
    return joined.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*name.values()).toDF(*docs.columns)
