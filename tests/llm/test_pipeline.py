import numpy as np
import pytest

import corpus_pipeline
from blockframe.llm import packing


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(7)
    word = lambda: "".join(rng.choice(("an", "tion", "er", "ou", "th", "ble", "re")) for _ in range(rng.randint(1, 4)))
    words = lambda n: " ".join(word() for _ in range(n))
    passage, leak, leak2, leak3 = words(60), words(30), words(30), words(30)
    clean = {i: words(150) for i in range(40)}
    rows = dict(clean)
    rows |= {100: clean[3], 101: clean[4].replace(clean[4].split()[20], "zzz", 1), 102: words(20), 103: None, 104: "a b c " * 60}
    rows |= {110: words(90) + " " + passage, 111: words(90) + "\n" + passage + "\n" + words(90), 120: words(60) + " " + leak + " " + words(40) + " " + leak2, 121: words(60) + " " + leak3, 122: words(60) + " " + " ".join(leak2.split()[:12])}
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string"
    docs = spark.createDataFrame([(i, t, None, "x", None if t is None else len(t), 1, "y") for i, t in rows.items()], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak), (1, leak2), (2, leak3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    now, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id for r in now.collect()})
        if name != "packing":
            assert sorted(now.columns) == sorted(docs.columns)
        if name == "substrings":
            text = {r.doc_id: r.text for r in now.collect()}
            assert passage in text[110] and passage not in text[111] and len(text[111].split()) == 180
            assert all(text[i] == t for i, t in clean.items())
    every = set(rows)
    assert seen[0] == every - {102, 103, 104}
    assert seen[1] == seen[0] - {100, 101}
    # one window of one item is enough to go
    assert seen[3] == seen[2] - {120, 121, 122}
    total = sum(r.length for r in now.collect())
    assert now.select("sequence_id").distinct().count() <= -(-total // 2048) + 1
    again = corpus_pipeline.run(spark, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, again.select(columns).collect())) == sorted(map(tuple, now.select(columns).collect()))


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_places_of_ranks(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 65, 500), np.full(40, 64), np.full(300, 3)])
    plan = packing.Plan(packing.bin_completion(np.bincount(lengths, minlength=65), 64))
    bins = {}
    for n in np.unique(lengths):
        k = int((lengths == n).sum())
        for s, o in zip(*plan.place(np.full(k, n), np.arange(k))):
            bins.setdefault(int(s), []).append((int(o), int(n)))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-int(lengths.sum()) // 64) + 1
