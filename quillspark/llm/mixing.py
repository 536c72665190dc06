"""Mixing sources to target shares by a low-discrepancy schedule.

Van der Corput points, mapped through the cumulative weights, say which source each slot of the mix
belongs to; the n-th slot of a source takes the source's n-th block of about equally many tokens,
and the documents of a source fill its blocks in a shuffled order, once more for each repeat. All in
integers: weights are widths in units of 2 ** -UNITS, a width is a few dyadic intervals, and the points in
a dyadic interval are every 2 ** L-th, so each source's slots and their ranks are written down directly.
Sources are compared trimmed, in lower case and with ``-`` as ``_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.words import token_count
from quillspark.llm.prefix import running_total
from quillspark.session import cut_lineage

BLOCK, UNITS, TENTHS = 4096, 40, 10


def source_key(source: Column) -> Column:
    return F.translate(F.lower(F.trim(source)), "-", "_")


def _targets(targets: DataFrame) -> DataFrame:
    """(key, source, weight, max_repeats, share) of usable targets: source and positive weight given.

    Of several rows of a source the one with the largest weight holds; null repeats count 1, negative ones 0.
    """
    rows = targets.select(source_key(F.col("source")).alias("key"), "source", "weight", "max_repeats").filter("key is not null and weight > 0 and not isnan(weight)")
    one = rows.groupBy("key").agg(F.max(F.struct("weight", F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), "source")).alias("x"))
    one = one.select("key", "x.source", F.col("x.weight").cast("double").alias("weight"), F.greatest("x.max_repeats", F.lit(0)).alias("max_repeats"))
    return one.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0))))


def _sized(documents: DataFrame) -> DataFrame:
    """(doc_id, key, tokens), a narrow table that is counted once and read often."""
    return documents.select("doc_id", source_key(F.col("source")).alias("key"), token_count(F.col("text")).cast("long").alias("tokens"))


def source_shares(documents: DataFrame, targets: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """One row per target source: what it has, should give and gives in a mix as large as the table.

    source (as spelled in the targets), documents, tokens, target_share, target_tokens (share of the
    tokens of all rows, whatever their source), capacity (tokens times max_repeats), short (capacity
    below target), planned_tokens (the smaller of the two), planned_share (of all planned tokens).
    A source without documents has capacity 0. Null or unlisted sources count in the total only; an
    empty documents table makes every target 0 and nothing short.
    """
    sums = (sized if sized is not None else _sized(documents)).groupBy("key").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    out = _targets(targets).join(sums, "key", "left").join(F.broadcast(total))
    out = out.withColumns({"documents": F.coalesce("documents", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))})
    out = out.withColumn("capacity", F.col("tokens") * F.col("max_repeats")).withColumn("target_tokens", F.col("share") * F.col("total"))
    out = out.withColumn("planned_tokens", F.least(F.col("target_tokens"), F.col("capacity").cast("double")))
    return out.select(
        "key", "source", "documents", "tokens", "max_repeats", F.col("share").alias("target_share"), "target_tokens", "capacity", (F.col("capacity") < F.col("target_tokens")).alias("short"), "planned_tokens",
        F.try_divide("planned_tokens", F.sum("planned_tokens").over(Window.partitionBy(F.lit(0)))).alias("planned_share"),
    )


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = 17, bucket_rows: int = 50_000, slot_rows: int = 50_000, sized: DataFrame | None = None) -> DataFrame:
    """The mixed selection in order: source, doc_id, copy (from 1), tokens, slot, offset.

    Reading by (slot, offset, doc_id) gives the mix. A source's documents are taken in a shuffled
    order, then again in another for each further copy, as long as fewer tokens than planned came
    before; so it passes its plan by less than one document. Documents without tokens are left out;
    null ids stay. Repeated rows of a doc_id are distinct records. No task holds more than about
    ``bucket_rows`` rows of a source; each target source has one row in the plan.
    """
    sized = cut_lineage(_sized(documents)) if sized is None else sized
    plan = source_shares(documents, targets, sized).filter("planned_tokens > 0").select("key", "source", "documents", "tokens", "max_repeats", "planned_tokens")
    plan = plan.withColumn("copies", F.least(F.ceil(F.col("planned_tokens") / F.col("tokens")).cast("int"), "max_repeats"))
    known = sized.filter("tokens > 0").join(plan.select("key", "source", "copies", "planned_tokens", "documents"), "key")
    copies = known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    shuffled = F.xxhash64("doc_id", "copy", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    buckets = F.ceil(F.col("documents") / bucket_rows)
    at = F.floor(F.col("_h") / F.lit(float(1 << 62)) * buckets)
    ordered = running_total(copies.withColumn("_h", shuffled), ["key"], (F.col("copy") - 1) * (buckets + 1) + at, [F.col("copy"), F.col("_h"), F.col("doc_id")], F.col("tokens"), "before")
    chosen = ordered.filter("before < planned_tokens").select("key", "source", "doc_id", "copy", "tokens", F.floor(F.col("before") / block).alias("n"), (F.col("before") % block).alias("offset"))

    plan = plan.withColumn("blocks", (F.floor(F.col("planned_tokens") / block) + 2).cast("long"))
    ranked = slots(plan.select("key", F.col("planned_tokens").alias("weight"), "blocks"), slot_rows)
    slot = F.coalesce("slot", F.raise_error(F.concat(F.lit("no slot for block "), "n", F.lit(" of "), "key")).cast("long"))
    return chosen.join(ranked, ["key", "n"], "left").select("source", "doc_id", "copy", "tokens", slot.alias("slot"), "offset")


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative longs (a double would lose digits); b is a power of two."""
    return ((a - a % b) / b).cast("long")


def slots(plan: DataFrame, slot_rows: int = 50_000) -> DataFrame:
    """(key, n, slot), the slots of the blocks n = 0 .. blocks - 1 of a plan (key, weight > 0, blocks).

    A slot belongs to one key. The window over the plan has one row per key; no array is longer than ``slot_rows``.
    """
    every = Window.partitionBy(F.lit(0))
    room = F.lit(1 << UNITS) - F.count("*").over(every)
    width = F.floor(F.col("weight") / F.sum("weight").over(every) * room).cast("long") + 1
    edges = plan.withColumn("width", width).withColumn("hi", F.sum("width").over(every.orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("lo", F.col("hi") - F.col("width"))
    # The dyadic intervals of lo .. hi: at level t those at its ends that no interval of level t + 1 holds.
    edges = edges.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(UNITS)))).withColumn("size", F.expr("shiftleft(1L, t)"))
    edges = edges.withColumns({"l": F.expr("(lo + size - 1) div size"), "r": F.expr("hi div size")}).filter("l < r")
    ends = F.array_compact(F.array(F.when(F.col("l") % 2 == 1, F.col("l")), F.when(F.col("r") % 2 == 1, F.col("r") - 1)))
    bits = F.lit(UNITS) - F.col("t")
    parts = edges.withColumn("j", F.explode(ends)).withColumn("bits", bits)
    first = F.coalesce(F.conv(F.reverse(F.lpad(F.bin("j"), F.col("bits"), F.lit("0"))), 2, 10).cast("long"), F.lit(0).cast("long"))
    parts = parts.select("key", "blocks", "width", F.when(F.col("bits") > 0, first).otherwise(0).alias("first"), F.expr("shiftleft(1L, bits)").alias("step"))
    # Up to that slot there are as many of the key's points as blocks, each interval having one less than its share at most.
    of = Window.partitionBy("key")
    least = F.ceil((F.col("blocks") + F.count("*").over(of) + 1) * (float(1 << UNITS) / F.col("width"))).cast("long")
    parts = parts.withColumn("all", F.collect_list(F.struct("first", "step")).over(of)).withColumn("upto", least)
    parts = parts.withColumn("count", F.expr("greatest((upto - first + step - 1) div step, 0L)")).filter("count > 0")
    chunks = parts.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(count - 1) div {slot_rows}")))).repartition("key", "first", "chunk")
    terms = chunks.withColumn("i", F.explode(F.sequence(F.col("chunk") * slot_rows, F.least((F.col("chunk") + 1) * slot_rows, F.col("count")) - 1)))
    terms = terms.withColumn("slot", F.col("first") + F.col("i") * F.col("step"))
    before = F.aggregate("all", F.lit(0).cast("long"), lambda n, p: n + F.when(F.col("slot") > p["first"], _div(F.col("slot") - p["first"] - 1, p["step"]) + 1).otherwise(0))
    return terms.withColumn("n", before).filter("n < blocks").select("key", "n", "slot")


def reached_shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """Per target source what the mix gives of it: source, target_share, target_tokens, documents (distinct records
    used), rows, tokens, actual_share, short (fewer tokens than its target). Shares of an empty mix are null."""
    sized = cut_lineage(_sized(documents))
    got = mix(documents, targets, sized=sized, **options).groupBy("source").agg(F.count_if(F.col("copy") == 1).alias("documents"), F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    out = source_shares(documents, targets, sized).select("source", "target_share", "target_tokens").join(got, "source", "left").fillna(0, ["documents", "rows", "tokens"])
    return out.withColumn("actual_share", F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy(F.lit(0))))).withColumn("short", F.col("tokens") < F.col("target_tokens"))


def short_sources(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """source of every target that the mix doesn't reach, however often the source's rows are used."""
    return reached_shares(documents, targets, **options).filter("short").select("source")


def prefix_shares(documents: DataFrame, targets: DataFrame, tenths: int = TENTHS, **options) -> DataFrame:
    """How well the order keeps the shares: source, part (1 to ``tenths``), tokens and share of the source in the
    first ``part`` of equally many slots, planned_share, deviation of the two."""
    mixed = cut_lineage(mix(documents, targets, **options).select("source", "slot", "tokens"))
    last = mixed.agg((F.max("slot") + 1).alias("slots"))
    part = F.least(F.floor(F.col("slot") * tenths / F.col("slots")) + 1, F.lit(tenths)).cast("int")
    sums = mixed.join(F.broadcast(last)).groupBy("source", part.alias("part")).agg(F.sum("tokens").alias("t"))
    grid = sums.select("source").distinct().withColumn("part", F.explode(F.sequence(F.lit(1), F.lit(tenths))))
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = grid.join(sums, ["source", "part"], "left").withColumn("tokens", F.sum(F.coalesce("t", F.lit(0))).over(upto)).drop("t")
    runs = runs.withColumn("share", F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy("part"))))
    whole = runs.filter(F.col("part") == tenths).select("source", F.col("share").alias("planned_share"))
    return runs.join(whole, "source").withColumn("deviation", F.abs(F.col("share") - F.col("planned_share")))
