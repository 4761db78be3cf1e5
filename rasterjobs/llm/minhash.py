"""MinHash near-duplicates by a multi-index Hamming join on b-bit signatures, with links confirmed on full sets.

Signature: ``chunks * cells`` cells of 16 bits, each the low bits of one minimum over the document's shingle
hashes (b-bit minwise hashing); the distance of two signatures is the number of cells that differ. Each
signature is split into ``chunks`` chunks. By the pigeonhole principle two signatures within
``chunks * (errors + 1) - 1`` differing cells have a chunk with at most ``errors`` of them; each chunk is
indexed once for every choice of ``errors`` cells left out, so all such pairs meet in a bucket.

The work stays near-linear in hot groups. Equal sets are one class before the join. A bucket compares its
members with one of them first, the one that meets most others. Members of different components that remain
in one bucket meet again on their rarest shingles: a link needs so many common shingles that one of them is in the short
prefix of either, by rising frequency. So every pair that shares a bucket is confirmed, ruled out or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterjobs.llm.textops import U, mix, shingle_sets, slices
from rasterjobs.operators.components import connected_components
from rasterjobs.operators.skew import salted_join
from rasterjobs.runtime import drop, ship, snapshot

CHUNKS, CELLS, ERRORS = 10, 5, 1
_SEEDS = np.random.default_rng(20240917).integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)


def guaranteed_distance(chunks: int = CHUNKS, errors: int = ERRORS) -> int:
    """Every pair of signatures within this many differing cells shares a bucket."""
    return chunks * (errors + 1) - 1


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` cells of 16 bits; the shingle set must not be empty."""
    a, b = _SEEDS[0, :size] | U(1), _SEEDS[1, :size]
    low = np.full(size, U(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 4096):
            part = shingles[None, i : i + 4096] * a[:, None]
            part ^= part >> U(31)
            part *= b[:, None] | U(1)
            np.minimum(low, part.min(axis=1), out=low)
    return (mix(low) >> U(48)).astype(np.uint16)


def _sign(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            n, fa, fb, sig = [], [], [], []
            for s in shingle_sets(texts, k):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    fa.append(int(s.sum().astype(np.int64)) if len(s) else 0)
                    fb.append(int(mix(s, 11).sum().astype(np.int64)) if len(s) else 0)
                sig.append(signature(s, size).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.array(sig, pa.binary())], ["id", "n", "fa", "fb", "sig"])


def _index(batches: Iterator[pa.RecordBatch], chunks: int, cells: int, errors: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, id, n): a key for each chunk and each choice of left-out cells."""
    kept = list(combinations(range(cells), cells - errors))
    for batch in batches:
        for i in range(0, batch.num_rows, 2048):
            part = batch.slice(i, 2048)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, chunks, cells).astype(U)
            keys = np.empty((len(sig), chunks, len(kept)), U)
            with np.errstate(over="ignore"):
                for j, use in enumerate(kept):
                    packed = np.zeros((len(sig), chunks), U)
                    for c in use:
                        packed = mix(packed * U(0x9E3779B97F4A7C15) + sig[:, :, c])
                    keys[:, :, j] = mix(packed + (np.arange(chunks, dtype=U) * U(1000) + U(j))[None, :], 5)
            each = chunks * len(kept)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part.column("id").to_numpy(zero_copy_only=False), each)), pa.array(np.repeat(part.column("n").to_numpy(zero_copy_only=False), each))], ["key", "id", "n"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (a, salt, is_member): the set of ``a`` comes first, then those of its partners ``b``."""
    at, base = None, None
    for batch in batches:
        for part, texts in slices(batch, "text"):
            a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
            out_a, out_b = [], []
            for i, s in enumerate(shingle_sets(texts, k)):
                if b[i] is None:
                    at, base = a[i], s
                elif at == a[i]:
                    both = len(np.intersect1d(base, s, assume_unique=True))
                    if 100 * both >= percent * (len(base) + len(s) - both) and both:
                        out_a.append(a[i])
                        out_b.append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _explode(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            sets = list(shingle_sets(texts, k))
            sizes = [len(s) for s in sets]
            cols = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes) for c in ("id", "c", "n"))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), *map(pa.array, cols)], ["h", "id", "c", "n"])


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose full sets reach the similarity. A text with many partners is dealt over salts."""
    pairs = snapshot(pairs, "pairs")
    load = snapshot(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).withColumn("salts", F.ceil(F.col("m") / 64).cast("int")), "load")
    dealt = salted_join(pairs, load, "a", "m", ["b"]).select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    heads = load.select("a", F.lit(None).cast("long").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    heads = heads.join(texts.withColumnRenamed("id", "a"), "a").select("a", "b", "salt", "text")
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "b", "salt", "text")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = heads.unionByName(members).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(lambda it: _confirm(it, k, percent), "a long, b long")


def _by_rare_shingles(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, n, c) of different components c that may link.

    What two of them share are shingles that two components have. Those of a member stand by rising frequency. With
    a link their first common one is so early that enough follow on both sides, so pairs meet on it alone.
    """
    shingles = members.join(texts, "id").select("id", "c", "n", "text").mapInArrow(lambda it: _explode(it, k), "h long, id long, c long, n long")
    shingles = snapshot(shingles, "shingles")
    both = shingles.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("h", "df")
    shared = salted_join(shingles, snapshot(both, "shared"), "h", "df", ["id"])
    own = Window.partitionBy("id")
    ranked = shared.withColumns({"s": F.count(F.lit(1)).over(own), "rank": F.row_number().over(own.orderBy("df", "h"))})
    left = snapshot(ranked.where(f"100 * (s - rank + 1) >= {percent} * n").select("h", "id", "n", "c", F.expr("s - rank + 1").alias("rest")), "prefixes")
    # a member that even the smallest set under its shingle, with the most shingles to follow there, doesn't admit pairs with none
    reach = left.groupBy("h").agg(F.min("n").alias("least_n"), F.max("rest").alias("most_rest"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").drop("lo", "hi")
    whole = salted_join(left, snapshot(reach, "reach"), "h", "df", ["id"])
    fitting = whole.where(f"{100 + percent} * least(rest, most_rest) >= {percent} * (n + least_n)")
    before, left = left, snapshot(fitting.select("h", "id", "n", "c", "rest"), "prefixes")
    drop(before)
    right = left.toDF("h2", "id2", "n2", "c2", "rest2")
    near = f"id < id2 and c <> c2 and 100 * least(n, n2) >= {percent} * greatest(n, n2) and {100 + percent} * least(rest, rest2) >= {percent} * (n + n2)"
    out = snapshot(left.join(right, (left.h == right.h2) & F.expr(near)).select(F.col("id").alias("a"), F.col("id2").alias("b")).distinct(), "rest")
    drop(shingles, left)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, chunks: int = CHUNKS, cells: int = CELLS, errors: int = ERRORS) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each distinct non-null doc_id.

    Documents link where 100 * intersection >= percent * union of their distinct k-word shingles (A-Z
    lower-cased); with fewer words the whole sequence is the one shingle; null, empty or blank texts have an
    empty set and link with nothing. ``component_id`` is the smallest doc_id reachable, ``kept`` marks it.
    Rows that repeat a doc_id are one document that links by the text with most shingles (the greater
    fingerprint in ties); rows with a null doc_id are left out; an empty table gives an empty table. Other
    columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    size = chunks * cells
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    signed = source.mapInArrow(lambda it: _sign(it, k, size), "id long, n long, fa long, fb long, sig binary")
    signed = snapshot(signed, "signatures")
    one = signed.groupBy("id").agg(F.max(F.struct("n", "fa", "fb", "sig")).alias("x")).select("id", "x.*")
    one = snapshot(one, "documents")
    drop(signed)
    full = one.where("n > 0")
    classes = full.groupBy("fa", "fb", "n").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    reps = snapshot(classes.select(F.col("rep").alias("id"), "n", "fa", "fb", "sig"), "classes")
    keys = reps.select("id", "n", "sig").mapInArrow(lambda it: _index(it, chunks, cells, errors), "key long, id long, n long")
    many = snapshot(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "many")
    met = snapshot(salted_join(keys, many, "key", "members", ["id"]), "met")
    # a bucket's head is the member that meets most others, so that one comparison links as many as can be
    weight = met.groupBy("id").agg(F.sum("members").alias("weight"))
    heads = met.join(weight, "id").groupBy("key", "members").agg(F.max(F.struct("weight", -F.col("id"), "n")).alias("h")).select("key", "members", (-F.col("h.col2")).alias("head"), F.col("h.n").alias("head_n"))
    buckets = snapshot(salted_join(met.drop("members"), snapshot(heads, "heads"), "key", "members", ["id"]), "buckets")
    drop(many, met)
    stars = buckets.where("id <> head").where(f"100 * least(n, head_n) >= {percent} * greatest(n, head_n)").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    wanted = buckets.select("id").distinct()
    texts = snapshot(source.join(wanted, "id").join(reps.select("id", "fa", "n"), "id").select("id", "text", "fa", "n"), "texts")
    # a repeated doc_id: only a text of the counted set may speak for it
    if texts.count() > wanted.count():
        own = texts.mapInArrow(lambda it: _same_set(it, k), "id long, text string")
        texts = own.groupBy("id").agg(F.min("text").alias("text"))
    else:
        texts = texts.select("id", "text")
    links = snapshot(_verified(stars, texts, k, percent), "links")
    comps = connected_components(links)
    # members of one bucket in different components, beyond the pairs with the bucket's head
    placed = buckets.where("members > 2").join(comps.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "head", "members", F.coalesce("component", "id").alias("c"))
    placed = snapshot(placed, "placed")
    mixed = placed.groupBy("key", "members").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key", "members")
    open_ = salted_join(placed.drop("members"), snapshot(mixed, "mixed"), "key", "members", ["id"]).where("id <> head").select("id", "n", "c").distinct()
    more = snapshot(_verified(_by_rare_shingles(open_, texts, k, percent), texts, k, percent), "links")
    comps = connected_components(links.unionByName(more))
    drop(buckets, placed, links, more)
    by_rep = reps.select("fa", "fb", "n", F.col("id").alias("rep")).join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    by_rep = by_rep.select("fa", "fb", "n", F.coalesce("component", "rep").alias("component"))
    out = one.join(by_rep, ["fa", "fb", "n"], "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.expr("doc_id = component_id"))


def _same_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch, "text"):
            fa, n = part.column("fa").to_pylist(), part.column("n").to_pylist()
            ok = []
            for i, s in enumerate(shingle_sets(texts, k)):
                ok.append(len(s) == n[i] and int(s.sum().astype(np.int64)) == fa[i])
            yield part.select(["id", "text"]).filter(pa.array(ok, pa.bool_()))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the near-duplicates that :func:`near_duplicates` does not keep; columns unchanged.

    Rows with a null doc_id stay. Of rows that repeat a kept doc_id all stay.
    """
    kept = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("__kept"))
    stay = docs.join(kept, F.col("doc_id") == F.col("__kept"), "left_semi")
    return stay.unionByName(docs.where("doc_id is null"))
