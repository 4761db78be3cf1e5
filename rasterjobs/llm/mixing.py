"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Blocks go to the sources by highest quotients ``weight / (2 * blocks so far + 1)``, then each source's blocks go
to its shards the same way, none above what the shard may give; what the shards' last parts of blocks leave is dealt
in words. Inside a shard the documents stand in a seeded order and their words are cut into blocks; the shard's quota
takes blocks from the front, and starts over when the shard is used up. Sources, shards and quotients are tables:
nothing that grows with them reaches the driver or one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.operators.ranked import in_ranges, row_numbers, with_ranges
from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, snapshot

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents per shard of a source at most, on average; words per block; a source with a target of fewer blocks is dealt in words.
SHARD_ROWS, BLOCK, SOURCE_BLOCKS = 5_000, 256, 100


def _with_sums(parts: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """``parts`` with sums over its groups ``by`` (the whole table, if empty)."""
    found = parts.groupBy(*by).agg(*[F.sum(x).alias(name) for name, x in sums.items()])
    return parts.join(found, by) if by else parts.crossJoin(F.broadcast(found))  # one row


def fill_targets(sources: DataFrame, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, float]:
    """``sources`` (words, weight) with ``target``, and the targets' sum: ``share`` times all words by weight, none above ``most`` times its own.

    The excess is reshared by weight among the rest until none is above: of the sources by rising ``most * words / weight`` the
    first ones stop, and the rest share what is left at the first level that none of them exceeds. One ordered pass finds it.
    """
    full = F.col("__full")
    rows = sources.select(F.col("words").cast("long").alias("words"), F.col("weight").cast("double").alias("weight")).where("weight > 0").withColumn("__full", most * F.col("words") / F.col("weight"))
    placed = in_ranges(rows, ["__full"])
    whole = placed.agg(F.sum("words"), F.sum("weight")).first()
    total, weights = whole[0] or 0, whole[1] or 0.0
    names = ["words", "weight", "__full"]
    for c in ("words", "weight"):
        placed = with_ranges(placed, [], F.sum(c)).withColumnRenamed("__before", f"__{c}").drop("__all")
    upto = Window.partitionBy("__range").orderBy(*names[::-1]).rowsBetween(Window.unboundedPreceding, -1)
    words, weight = (F.col(before) + F.coalesce(F.sum(c).over(upto), F.lit(0)) for c, before in (("words", "__words"), ("weight", "__weight")))
    placed = placed.withColumns({"__w": words, "__g": weight}).withColumn("__level", (share * total - most * F.col("__w")) / (weights - F.col("__g")))
    found = placed.where(F.col("__level") <= full).agg(F.min_by("__level", F.struct("__full", "__w", "__g"))).first()[0]
    own = F.lit(float("inf") if found is None else found) * F.col("weight")
    target = F.when(F.col("weight") > 0, F.least(own, most * F.col("words").cast("double"))).otherwise(0.0)
    return sources.withColumn("target", target.cast("double")), min(share, most) * total


def apportion(parts: DataFrame, by: list[str], weight: str, seats: Column, order: list[str], cap: Column | None = None) -> DataFrame:
    """``parts`` with a positive ``weight`` and their ``seats``, by highest quotients weight / (2 s + 1) inside each group ``by``.

    Ties go to the earlier part in ``order``; none gets more than ``cap``. A common divisor gives every part the
    seats that it gets in any case; only the quotients that can still win are ranked, in sorted ranges.
    """
    names = parts.columns
    cap = F.lit(1 << 62) if cap is None else cap
    s = _with_sums(parts.where(F.col(weight) > 0).withColumn("__seats", seats), by, __all=F.col(weight), __n=F.lit(1))
    scale = F.greatest(F.lit(0.0), (F.col("__seats") - F.col("__n") / 2 - 1) / F.col("__all"))
    s = s.withColumn("__cap", cap).withColumn("__sure", F.least("__cap", F.floor(F.col(weight) * scale + 0.5).cast("long")))
    s = snapshot(_with_sums(s, by, __given=F.col("__sure")).withColumn("__open", F.col("__seats") - F.col("__given")), "parts")
    more = F.least(F.col("__open"), F.col("__cap") - F.col("__sure"), F.ceil((3 * F.col("__n") + 4) * F.col(weight) / F.col("__all")) + 2)
    next_ = s.where(more > 0).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), more.cast("long") - 1)))
    next_ = next_.withColumn("__quotient", F.col(weight) / (2 * (F.col("__sure") + F.col("__k")) + 1))
    ranked = row_numbers(next_.select(*by, *order, "__k", "__open", "__quotient"), by, [F.desc("__quotient"), *order, "__k"], "__rank")
    won = ranked.where(F.col("__rank") <= F.col("__open")).groupBy(*by, *order).agg(F.count(F.lit(1)).alias("__won"))
    return s.join(won, [*by, *order], "left").select(*names, (F.col("__sure") + F.coalesce("__won", F.lit(0))).alias("seats"))


def _shard_quotas(shards: DataFrame, block: int, most: int) -> DataFrame:
    """Rows (key, shard, words, quota) with a shard's part ``take`` of its source's quota, in words.

    No shard takes more whole blocks than ``most`` times its words hold, so the others get them; words that
    are then still open go to the shards in turn, up to their room.
    """
    got = apportion(shards, ["key"], "words", F.expr(f"quota div {int(block)}"), ["shard"], F.expr(f"words * {int(most)} div {int(block)}"))
    got = got.withColumn("take", F.col("seats") * block).withColumn("room", F.col("words") * most - F.col("take"))
    placed = with_ranges(in_ranges(_with_sums(got, ["key"], __given=F.col("take")), ["key", "shard"]), ["key"], F.sum("room"))
    upto = Window.partitionBy("key", "__range").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("__before") + F.sum("room").over(upto) - F.col("room")
    left = F.col("quota") - F.col("__given")
    return placed.select("key", "shard", "words", (F.col("take") + F.greatest(F.lit(0), F.least(F.col("room"), left - before))).alias("take"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` of every row.

    A size is the number of words of the text (null: 0). Sources stand by code point, null last, with
    ``weights`` repeating; they share ``share`` times all words, none above ``most`` times its own. ``taken``
    is the number of words the mix takes from a document, repeats counted, at most ``most`` times its size.
    Rows that repeat a doc_id are documents of their own, equal ones are counted first; reruns agree. A source
    without words has target and taken 0; an empty table gives an empty table; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = rows.groupBy("doc_id", F.isnull("source").alias("none"), F.coalesce("source", F.lit("")).alias("name"), "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = snapshot(rows, "sizes")
    names = ["none", "name"]
    sources = rows.groupBy(*names).agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("n"), F.count(F.lit(1)).alias("rows"))
    sources = row_numbers(sources, [], names, "key").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("key") - 1, F.lit(len(weights))) + 1).cast("int")))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("n") / SHARD_ROWS)).cast("int"))
    sources, _ = fill_targets(snapshot(sources, "sources"), share, most)
    # a source whose target is less than SOURCE_BLOCKS blocks is dealt in words among its like; it changes nothing for the others
    sources = snapshot(sources.withColumn("unit", F.when(F.col("target") < SOURCE_BLOCKS * block, 1).otherwise(block)), "units")
    units = F.broadcast(sources.groupBy("unit").agg(F.round(F.sum("target") / F.first("unit")).cast("long").alias("units")))  # two rows
    seats = apportion(sources.join(units, "unit"), ["unit"], "target", F.col("units"), ["key"]).select("key", (F.col("seats") * F.col("unit")).alias("quota"))
    sources = snapshot(sources.join(seats, "key", "left").select("key", *names, F.col("words").alias("source_size"), "target", F.coalesce("quota", F.lit(0)).alias("quota"), "shards", "rows"), "targets")
    rows = salted_join(rows, sources, names, "rows", ["doc_id", "size"], small=True).drop("rows", *names)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "size"), F.col("shards")).cast("int")).drop("shards")
    words = F.col("size") * F.col("copies")
    per = snapshot(rows.groupBy("key", "shard", "quota").agg(F.sum(words).alias("words")), "shards")
    quotas = snapshot(_shard_quotas(per, block, most), "quotas").withColumnRenamed("words", "shard_words")
    drop(per)
    order = Window.partitionBy("key", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "size")
    rows = rows.withColumn("end", F.sum(words).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(quotas, ["key", "shard"], "left")
    part = F.expr("take % shard_words") - (F.col("end") - words)  # what the last round takes of this row and its copies
    rows = rows.withColumn("part", part).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    own = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - F.col("copy") * F.col("size")))
    taken = F.when(F.col("shard_words") > 0, F.expr("take div shard_words") * F.col("size") + own).otherwise(0)
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The pipeline's form: each document as often as the mix takes it; of a part taken the larger half counts as the whole.

    Rows that repeat a doc_id (null is one too) all stand as often as the one taken most. Columns are unchanged,
    whatever their names; an empty table gives an empty table.
    """
    times = mix(docs, **options).where("taken > 0").select(F.col("doc_id").alias("__id"), F.expr("cast((2 * taken + size) div (2 * size) as int)").alias("__n")).where("__n > 0")
    times = times.groupBy("__id").agg(F.max("__n").alias("__n"))
    flat = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").cast("long").alias("__d"))
    out = flat.join(times, F.col("__d").eqNullSafe(F.col("__id"))).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
