"""The stages of the pipeline on small tables, each held against what it should do with its own input."""

import collections
import random
import re

import corpus_pipeline
from sevra.llm import mixing


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [a + b for a in ("ba", "ce", "di", "fo", "gu") for b in ("n", "rt", "s", "m", "x")]
    rows, labels = [(0, None, "en", "a", None), (1, "", "en", "a", 0)], []
    for i in range(2, 262):
        w = [rng.choice(vocabulary) for _ in range(80)]
        if i % 6 == 0:
            w[10] = w[40] = "nastyword"
        labels.append((i, 1, int(i % 6 == 0)))
        rows.append((i, " ".join(w), "en", "hot" if i % 3 else rng.choice("abc"), 1))
    rows += [(300 + i, rows[7][1], "en", "a", 1) for i in range(5)]
    rows.append((400, rows[9][1] + " more words", "en", "b", 1))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_near_dedup", "mixing_sources", "best_fit_packing"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {r[0] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert docs.columns == columns
        got = [r["doc_id"] for r in docs.collect()]
        if name == "toxicity":
            kept -= {i for i, _, y in labels if y}
        elif name == "exact_dedup":
            kept -= {0, 7, *range(300, 304)}
        elif name == "minhash_near_dedup":
            kept -= {400}
        if name == "mixing_sources":
            rows_in = before.collect()
            size = {r["doc_id"]: len(re.findall(r"\S+", r["text"] or "")) for r in rows_in}
            goal = {r["doc_id"]: r["target"] for r in mixing.mixed(before).collect()}
            words = collections.Counter()
            for r in docs.collect():
                words[r["source"]] += size[r["doc_id"]]
            assert all(abs(words[r["source"]] - goal[r["doc_id"]]) <= 80 / 2 + mixing.BLOCK for r in rows_in)
            assert max(collections.Counter(got).values()) <= mixing.MOST and len(set(got)) < len(rows_in) + 1
        else:
            assert sorted(got) == sorted(kept)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert sum(r["n_words"] for r in packed) == sum(len(re.findall(r"\S+", r["text"])) for r in docs.collect())
    assert len({(r["bin_id"], r["doc_id"]) for r in packed}) == len(packed)
