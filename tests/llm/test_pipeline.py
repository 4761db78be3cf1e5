"""The pipeline's stages on a small table: columns, order, and what each stage takes out."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from rasterjobs.llm import mixing
from rasterjobs.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm.test_operators import blocks_by_hand, groups_by_hand

WORDS = ["the", "ing", "tion", "ouer", "and", "rely"]


def test_stages_and_queries_are_registered():
    import __spark_entry__ as e

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "minhash_near_dedup", "mixing", "packing"]
    assert set(QUERIES) <= set(e.queries()) and "pipeline" in e.queries() and set(ORACLES) <= set(QUERIES)
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))


def test_each_stage_keeps_the_columns_and_its_decisions_hold(spark):
    rng = random.Random(1)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    rows = [(i, text(60) + "\n" + text(40), "en", f"s{i % 2}", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, None, "en", "s1", 1), (102, "12 34", "en", "s1", 1)]
    near = rows[3][1].replace("\n", " ").split()
    near[10] = "other"
    rows.append((103, " ".join(near), "en", "s1", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "").cache()
        seen[name] = {r.doc_id for r in out.collect()}
        if name != "packing":
            assert out.columns == docs.columns and out.schema == docs.schema or [f.name for f in out.schema] == docs.columns
        docs = out
    assert not {101, 102} & seen["language_id"] and 100 in seen["language_id"]
    assert 100 not in seen["line_dedup"] and 103 in seen["line_dedup"] and 103 not in seen["minhash_near_dedup"]
    assert seen["mixing"] <= seen["minhash_near_dedup"] and seen["packing"] == seen["mixing"]


def test_the_whole_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(n))
    block = [text(9), text(30), text(4)]
    rows = []
    for i in range(120):
        lines = [text(rng.randrange(1, 25)) for _ in range(rng.randrange(1, 5))]
        if i % 5 == 0:
            lines[1:1] = block
        if i % 7 == 3 and rows:  # near copies with another order of lines, exact ones and junk
            words = rows[rng.randrange(len(rows))][1].split()
            words[rng.randrange(len(words))] = "new"
            lines = [" ".join(words)]
        rows.append((i, "\n".join(lines) if i % 31 else ["12 -- 7", "", None, "!"][i // 31], "en", f"s{i % 3}", 1))
    folder = tmp_path / "sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{folder}").collect()

    lettered = [(i, t) for i, t, *_ in rows if t and any(c.isalpha() for c in t)]
    left = [(i, "\n".join(lines)) for (i, _), lines in zip(lettered, blocks_by_hand([t for _, t in lettered]), strict=True)]
    left = [(i, t) for i, t in left if t.split()]
    groups = groups_by_hand(left)
    kept = {i: t for i, t in left if groups[i][1] == i}
    source = {i: s for i, _, _, s, _ in rows}
    mixed = mixing.mix(spark.createDataFrame([(i, t, source[i]) for i, t in kept.items()], "doc_id long, text string, source string")).collect()
    per_source = {}
    for r in mixed:
        per_source.setdefault(source[r.doc_id], [0, r.target])[0] += r.taken
    assert all(abs(taken - target) <= 0.02 * target for taken, target in per_source.values())
    times = {r.doc_id: (2 * r.taken + r.size) // (2 * r.size) for r in mixed if r.taken}
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, n in times.items():
        ids = [*tok.encode(kept[i], add_special_tokens=False).ids, 0]
        want += [(i, p, 2048 * p, len(ids[2048 * p : 2048 * p + 2048]), zlib.crc32(np.array(ids[2048 * p : 2048 * p + 2048], "<u4").tobytes())) for p in range(-(-len(ids) // 2048))] * n
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
