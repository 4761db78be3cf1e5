"""Secret scans in SQL functions only: base patterns, and tokens that a character Markov model finds random.

Two first-order Markov models over characters are trained, one from random strings and one from ordinary
identifiers. A token whose mean log-likelihood ratio per pair of characters exceeds a threshold is a secret. The
trained table of ratios is one array constant, so a scan is a single pass without shuffle, join or Python. Positions
are running sums of lengths, taken in chunks, so a scan's time grows with a text's length, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, with the least length of the part that decides.
KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{12,}"  # from the first AKIA to the run's end: the same as runs of 16 or more
HEX = "(?<![0-9a-f])[0-9a-f]{32,}"  # a run of fewer from its start has no match further on
LEAST_ASSIGN = 8
KINDS = ("assign", "access", "hex", "markov")
#: Tokens for the models: runs of these characters. Shorter ones aren't judged.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
LEAST_TOKEN = 16
#: Mean log ratio per pair from which a token is a secret.
THRESHOLD = 1.0
#: Labelled samples: words of about so many documents as identifiers, and one random string for about so many of these words. A
#: random string has about 40 characters, a word 6 or more: with 8 words a string both models count about as many pairs, so neither is smoother.
SAMPLE_DOCS, WORDS_PER_RANDOM = 2_000, 8
#: Weight of the back-off to single characters, in pairs.
BACK_OFF = 8.0
#: Elements per chunk of a running sum.
CHUNK = 64
SPANS = "array<struct<s:int,e:int,m:string>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, step: Callable[[Column, Column], Column], zero: int) -> Column:
    """``step`` over all elements up to each one of an integer array, in chunks: copies stay within CHUNK elements."""

    def within(part: Column, start: Column) -> Column:
        grown = F.aggregate(part, F.array(start), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(grown, F.lit(2), F.size(part))

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / CHUNK).cast("int")), lambda c: F.slice(v, c * CHUNK + 1, F.lit(CHUNK)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(zero), step))
        before = F.aggregate(totals, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), within))

    return _let(values, lambda v: _let(chunked(v), joined))


def _located(text: str, pattern: str, found: str) -> Column:
    """``array<struct<s, e, m>>``: code-point ranges of all matches, from the lengths of matches and of the gaps between them."""
    gaps = F.slice(F.transform(F.split(F.col(text), pattern, -1), lambda g: F.length(g)), F.lit(1), F.size(found))
    ends = running(F.zip_with(gaps, F.col(found), lambda g, m: g + F.length(m)), lambda a, b: a + b, 0)
    spans = F.zip_with(F.col(found), ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
    return F.when(F.size(found) > 0, spans.cast(SPANS)).otherwise(F.array().cast(SPANS))


def base_spans(docs: DataFrame, least: int = LEAST_TOKEN) -> DataFrame:
    """``docs`` (doc_id, text) with arrays ``assign``, ``access``, ``hex`` and ``token`` of code-point ranges.

    A pattern is only tried on a text that holds what all its matches hold.
    """
    low, none = F.lower("text"), F.array().cast("array<string>")
    keyword = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api")
    first = {"token": None, "assign": keyword, "access": F.col("text").contains("AKIA"), "hex": F.size("token_m") > 0 if least <= 32 else F.lit(True)}
    rows = docs
    for kind, pattern in (("token", TOKEN % least), ("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        found = _matches(F.col("text"), pattern)
        rows = rows.withColumn(f"{kind}_m", found if first[kind] is None else F.when(first[kind], found).otherwise(none))
        spans = _located("text", pattern, f"{kind}_m")
        if kind == "assign":
            value = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2))
            spans = F.filter(spans, lambda x: value(x) >= LEAST_ASSIGN)
        rows = rows.withColumn(kind, spans)
    return rows.drop("token_m", "assign_m", "access_m", "hex_m")


def _part(n: int, bound: int) -> int:
    """How many of 10^12 hashes a sample of about ``bound`` of ``n`` rows takes."""
    return 10**12 if n <= bound else max(1, 10**12 * bound // n)


def random_string(seed: Column, kind: Column) -> Column:
    """A string without structure from a digest of ``seed``: hexadecimal, base64, its URL form, or capitals and digits by ``kind`` 0 to 3."""
    raw = F.regexp_replace(F.base64(F.unhex(F.sha2(seed, 512))), "[=\\s]", "")
    forms = (F.substring(F.sha2(seed, 256), 1, 40), F.substring(raw, 1, 40), F.translate(F.substring(raw, 41, 40), "+/", "-_"), F.regexp_replace(raw, "[^A-Z0-9]", ""))
    return F.when(kind == 0, forms[0]).when(kind == 1, forms[1]).when(kind == 2, forms[2]).otherwise(forms[3])


def labelled_samples(docs: DataFrame, bound: int = SAMPLE_DOCS, per_random: int = WORDS_PER_RANDOM) -> DataFrame:
    """``(token, random)`` from ``docs`` (doc_id, text): words of documents as ordinary identifiers, and random strings.

    Words come from a hashed sample of about ``bound`` documents, without what the base patterns find. Every
    ``per_random``-th word, by hash of its place, seeds a random string, so both labels hold by construction and
    neither needs a secret in the corpus. A corpus without words teaches nothing.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(10**12)) < _part(docs.count(), bound))
    plain = F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS + "|" + HEX, " ")
    words = some.select("doc_id", F.posexplode(_matches(plain, TOKEN % 6)).alias("at", "token"))
    seed = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("at").cast("string"), F.col("token")).cast("binary")
    h = F.xxhash64("doc_id", "at", "token")
    made = F.when(F.pmod(h, F.lit(per_random)) == 0, random_string(seed, F.pmod(F.shiftright(h, 8), F.lit(4))))
    pair = F.array(F.struct(F.col("token"), F.lit(False).alias("random")), F.struct(made.alias("token"), F.lit(True).alias("random")))
    return words.select(F.explode(pair).alias("x")).select("x.*").where("token is not null")


def train(samples: DataFrame) -> list[float]:
    """Log ratios of transition probabilities (random over ordinary), 128 x 128 by code of the first and second character.

    Either model counts the pairs of its label, backed off to how often its second character follows any.
    Without both labels all ratios are 0. What is collected has at most 2 x 128 x 128 rows.
    """
    pairs = samples.where("token is not null and random is not null and length(token) > 1")
    pairs = pairs.groupBy("random", "token").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.select("n", "random", "token", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("i"))
    pairs = pairs.select("n", "random", F.ascii(F.substring("token", F.col("i"), F.lit(1))).alias("a"), F.ascii(F.substring("token", F.col("i") + 1, F.lit(1))).alias("b"))
    counts = pairs.where("a < 128 and b < 128").groupBy("random", "a", "b").agg(F.sum("n").alias("n")).collect()
    count = {True: [0.0] * 16384, False: [0.0] * 16384}
    for r in counts:
        count[r["random"]][128 * r["a"] + r["b"]] = float(r["n"])
    if not any(count[True]) or not any(count[False]):
        return [0.0] * 16384

    def transitions(n: list[float]) -> list[float]:
        total = [sum(n[128 * a : 128 * a + 128]) for a in range(128)]
        second = [(sum(n[b::128]) + 0.5) / (sum(total) + 64) for b in range(128)]
        return [(n[i] + BACK_OFF * second[i % 128]) / (total[i // 128] + BACK_OFF) for i in range(16384)]

    return [round(math.log(x / y), 6) for x, y in zip(transitions(count[True]), transitions(count[False]), strict=True)]


def log_ratio(token: Column, ratios: list[float]) -> Column:
    """Mean log ratio per pair of an ASCII token's characters."""
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # a constant: folded once
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.get(table, F.least(a, F.lit(127)) * 128 + F.least(b, F.lit(127))))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(codes) - 1, F.lit(1))


def _apart(tokens: Column, base: Column) -> Column:
    """Those of ``tokens`` that overlap none of ``base``: both sorted by start, with the furthest end before and the next start after."""
    far = (1 << 31) - 1
    ranked = lambda k: lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))
    merged = F.array_sort(F.concat(F.transform(base, ranked(0)), F.transform(tokens, ranked(1))))

    def chosen(every: Column) -> Column:
        reached = running(F.transform(every, lambda x: F.when(x["k"] == 0, x["e"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        ahead = F.reverse(running(F.transform(F.reverse(every), lambda x: F.when(x["k"] == 0, x["s"]).otherwise(far)), lambda a, b: F.least(a, b), far))
        marked = F.arrays_zip(every.alias("x"), reached.alias("r"), ahead.alias("a"))
        free = F.filter(marked, lambda z: (z["x"]["k"] == 1) & (z["r"] <= z["x"]["s"]) & (z["a"] >= z["x"]["e"]))
        return F.transform(free, lambda z: F.struct(z["x"]["s"].alias("s"), z["x"]["e"].alias("e")))

    return _let(merged, chosen)


def scan(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, least: int = LEAST_TOKEN) -> DataFrame:
    """``(doc_id, assign, access, hex, markov)``: ranges by kind. The method adds ``markov`` ranges that overlap no base range."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = base_spans(rows, least).drop("text")
    rows = rows.withColumn("odd", F.filter("token", lambda x: log_ratio(x["m"], ratios) >= threshold)).drop("token")
    rows = rows.withColumn("base", F.concat(*KINDS[:3]))
    none = F.array().cast("array<struct<s:int,e:int>>")
    return rows.withColumn("markov", F.when(F.size("odd") > 0, _apart(F.col("odd"), F.col("base"))).otherwise(none)).select("doc_id", *KINDS)


def _listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""

    def ranked(i: int, kind: str):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), x["e"].alias("e"), F.lit(kind).alias("k"))

    every = [F.transform(kind, ranked(i, kind)) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*every)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def secret_spans(docs: DataFrame, samples: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` of every row; ranges count code points, the end is exclusive.

    ``samples`` are labelled tokens (token, random), by default :func:`labelled_samples` of ``docs``. A null
    text is empty: no ranges, the digest of an empty string. Repeated rows are scanned one by one. A text of any
    length is scanned whole; an empty table gives an empty table; other columns are not read.
    """
    found = scan(docs, train(labelled_samples(docs) if samples is None else samples), threshold)
    base = KINDS[:3]
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(KINDS).alias("spans"))
