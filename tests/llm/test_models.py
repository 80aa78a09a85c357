import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import WORD, lower

from blockframe.llm import chat, language, recurrent, toxicity


def test_toxicity(spark, corpus, empty):
    rng = random.Random(2)
    plain = [f"{a}{b}" for a in ("an", "the", "on", "re") for b in ("tion", "ing", "er", "ly", "o")]
    bad = ["grobnik", "zwamp", "murxel"]
    line = lambda n, toxic: " ".join(rng.choice(bad) if toxic and rng.random() < 0.1 else rng.choice(plain) for _ in range(n))
    texts = [(i, line(60, i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)] + [(5, 1), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600, 800) if any(b in texts[i][1] for b in bad) == (i % 5 == 0)]
    assert sum((rows[i] >= 0.3) == (i % 5 == 0) for i in held) / len(held) > 0.97
    odd = toxicity.score(corpus, model).collect()
    assert len(odd) == corpus.count() and all(0 <= r.score <= 1 and r.score == r.score for r in odd)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 1e-9 for r in toxicity.score(docs, none).collect()} == {True}
    one = toxicity.fit(docs, labels.where("toxic = 1"))
    assert {r.score > 0.99 for r in toxicity.score(docs, one).collect()} == {True}


def test_language(spark, corpus, empty):
    rng = random.Random(3)
    parts = {"xa": ["ung", "sch", "keit", "der"], "xb": ["tion", "eau", "les", "qui"], "xc": ["ando", "cion", "ez", "los"]}
    make = lambda k: " ".join("".join(rng.choice(parts[k]) for _ in range(rng.randint(1, 3))) for _ in range(25))
    rows = [(i, make(k), k) for i, k in enumerate(list(parts) * 80)]
    docs = spark.createDataFrame([*rows, (900, "zz", None), (901, None, "xa")], "doc_id long, text string, lang string").repartition(2)
    model = language.fit(docs.where("doc_id % 5 <> 1"))
    assert model.languages == ["xa", "xb", "xc"] and 12 < model.code.shape[1] <= language.BITS
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) / len(rows) > 0.98
    assert got[901].lang_pred == "und" and got[901].score == 0
    odd = {r.doc_id: r for r in language.identify(corpus, model).collect()}
    assert {odd[i].lang_pred for i in (33, 34, 35, 39)} == {"und"} and odd[40].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in odd.values())
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs.limit(0))).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'xb'"))
    assert {r.lang_pred for r in language.identify(docs, single).collect()} == {"xb", "und"}
    halves = language.identify(spark.createDataFrame([(1, make("xa") + " " + make("xb"))], "doc_id long, text string"), model).first()
    assert {halves.lang_pred, halves.runner_up} == {"xa", "xb"} and halves.ambiguous
    assert sum(got[i].ambiguous for i, _, _ in rows) < 0.05 * len(rows)


def test_codewords_are_far_apart():
    code = language.codewords(5)
    assert min((code[i] != code[j]).sum() for i in range(5) for j in range(i)) >= 8


def vocabulary():
    head = [(i << 16 | i % 7, 100 - i) for i in range(1, 90)]
    return recurrent.Vocabulary.build(head, np.array([(s, 700, 40, 12) for s in range(200)]), 140000, 8000, most=100)


def test_gradients():
    rng = np.random.default_rng(0)
    v = vocabulary()
    net = recurrent.Network.new(v, 6)
    net.weights = {k: x.astype(float) + rng.standard_normal(x.shape) * 0.1 for k, x in net.weights.items()}
    net.weights["wb"] = np.maximum(net.weights["wb"], -5)
    token, target = rng.integers(0, 89, (5, 3)), rng.integers(0, 89, (5, 3))
    token[2, 1], target[0] = 3, 100 + np.arange(3)
    h = rng.standard_normal((3, 6)) * 0.3
    _, g, _ = net.gradients(token, target, h, 3)
    for k, x in net.weights.items():
        spots = np.argwhere(np.abs(g[k]) > 1e-4)
        for at in map(tuple, spots[rng.integers(0, len(spots), 5)]):
            old, d = x[at], 1e-3
            x[at] = old + d
            up = net.gradients(token, target, h, 3)[0]
            x[at] = old - d
            down = net.gradients(token, target, h, 3)[0]
            x[at] = old
            assert abs((up - down) / (2 * d) - g[k][at]) < 1e-5


def test_probabilities_sum_to_one():
    v = vocabulary()
    net = recurrent.Network.new(v, 6)
    places = v.head_classes * recurrent.PER_CLASS
    ids = np.concatenate([np.arange(89), places + np.arange(recurrent.TAIL)])
    h = np.random.default_rng(1).standard_normal((1, 6)).astype(np.float32)
    assert abs(np.exp(net.log_probability(np.repeat(h, len(ids), 0), ids)).sum() - 1) < 1e-4
    # within a tail class, its words' shares and the unseen word's
    k = int(np.argmax(v.mass))
    known = np.exp(v.within(np.full(1, places + k), np.array([v.mass[k]])))[0]
    unseen = np.exp(v.within(np.full(1, places + k), np.array([0])))[0]
    assert abs(known + unseen - 1) < 1e-9


def test_scores_are_chains_of_steps():
    v = vocabulary()
    net = recurrent.Network.new(v, 6)
    rng = np.random.default_rng(2)
    first = np.array([0, 0, 7, 8, 30])
    ids, end = rng.integers(0, 89, 30), 5
    got = recurrent.score_documents(net, ids, first, end)
    for d in range(4):
        own, h, total = ids[first[d] : first[d + 1]].tolist(), np.zeros((1, 6), np.float32), 0.0
        for token, goal in zip([end, *own], [*own, end]):
            h = net.stepper()(np.array([token]), h)
            total += net.log_probability(h, np.array([goal]))[0]
        assert abs(got[d] - total) < 1e-3


def test_recurrent(spark, corpus, empty):
    from blockframe.llm.common import crc_mod

    docs = corpus.select("doc_id", "text", (crc_mod("doc_id", 7) == 2).alias("held_out"))
    rows = {r.doc_id: r for r in recurrent.score(docs, bucket_bytes=20000).collect()}
    texts = {r.doc_id: (r.text, r.held_out) for r in docs.collect()}
    count = {}
    tokens = {i: [*WORD.findall(lower(t)), None] for i, (t, _) in texts.items()}
    for i, (_, held) in texts.items():
        if not held:
            for w in tokens[i]:
                count[w] = count.get(w, 0) + 1
    total, types = sum(count.values()), len(count)
    assert rows.keys() == texts.keys()
    for i, own in tokens.items():
        r = rows[i]
        base = sum(math.log10((count.get(w, 0) + 1) / (total + types + 1)) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in count for w in own), total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert recurrent.score(empty.selectExpr("doc_id", "text", "true AS held_out")).count() == 0
    none = recurrent.score(docs.selectExpr("doc_id", "text", "true AS held_out")).collect()
    assert len(none) == len(rows) and all(r.n_known == 0 and r.score == r.score for r in none)


def test_every_training_document_is_learned_from(spark):
    # a group of copies of one text, whichever it is, teaches the network
    for word in ("ka", "lo", "mi"):
        text = f"{word} rra soö ment " * 400
        docs = spark.createDataFrame([(i, text, i % 10 == 0) for i in range(200)], "doc_id long, text string, held_out boolean").repartition(1)
        row = recurrent.score(docs).where("held_out").first()
        assert row.score > 0.8 * row.base_score, word


def test_streams_take_every_token():
    v = vocabulary()
    stream = np.concatenate([[0], np.full(2010, 3), np.full(4, 7), [0]])
    start = recurrent.Network.new(v, 6)
    before, after = start.weights["x"][7], recurrent.train(start, stream, 0, streams=15)[0].weights["x"][7]
    assert (before != after).any()


def test_training_learns_order():
    rng = np.random.default_rng(4)
    v = vocabulary()
    stream = np.concatenate([[0, *np.tile([3, 4, 5, 6], int(rng.integers(2, 6)))] for _ in range(600)])
    net, losses = recurrent.train(recurrent.Network.new(v, 8), stream, 0, streams=16)
    assert losses[-1] < 0.6 * losses[0]


def test_texts_are_split_once(spark):
    """Blocks carry words as numbers; what learns and scores reads no text."""
    rng = np.random.default_rng(6)
    texts = ["", "A b a", " ".join(f"w{x}" for x in range(70000)), " \n", "b " * 9]
    for some in (texts, texts[:2], ["", ""]):
        docs = pa.RecordBatch.from_pydict({"doc_id": pa.array([3, None, 5, 5, 9][: len(some)], pa.int64()), "text": some, "held_out": [True, False, False, True, False][: len(some)]})
        w = recurrent.Coded(docs.column("text"))
        got = recurrent.Block(recurrent.Block.packed(docs, w))
        assert got.doc_id.equals(docs.column("doc_id")) and got.held_out.equals(docs.column("held_out"))
        assert (got.first == w.first).all() and (got.keys[got.codes] == w.keys[w.codes]).all() and len(got.codes) == w.n
    # sums of rows by key, with keys of few rows and of many
    key, rows = np.minimum(rng.integers(0, 200, 900), 120), rng.standard_normal((900, 5))
    expected = np.zeros((300, 5))
    np.add.at(expected, key, rows)
    assert np.allclose(recurrent.row_sums(key, rows, 300), expected)
    docs = spark.createDataFrame([(i, "ka Lo ka", i == 1) for i in range(3)], "doc_id long, text string, held_out boolean").repartition(1)
    (block,) = recurrent._blocks(docs, 8).where("kind = 0").collect()
    got = recurrent.Block(bytes(block.data))
    assert got.codes.tolist() == [0, 1, 0] * 3 and len(got.keys) == 2 and sorted(got.doc_id.to_pylist()) == [0, 1, 2]


def test_optimiser_steps_are_those_of_the_formula():
    rng = np.random.default_rng(8)
    w = {"a": rng.standard_normal((300, 250)), "b": rng.standard_normal(3)}
    own, m, v, adam = {k: x.copy() for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, recurrent.Adam()
    for t in range(1, 6):
        g = {k: rng.standard_normal(x.shape) * 10.0 ** -t for k, x in w.items()}
        clip = min(1, 1 / np.sqrt(sum((x * x).sum() for x in g.values())))
        for k, x in g.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * clip * x, 0.99 * v[k] + 0.01 * (clip * x) ** 2
            own[k] -= 0.01 / (1 - 0.9**t) * m[k] / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
        adam.update(w, g, 0.01)
        assert all(np.allclose(w[k], own[k], atol=1e-9) for k in w)


@pytest.mark.parametrize("text", ["", "</s>", "[INST] ok [/INST]", "a\\</s>", "<\\/s>", "<\\\\s>", "<s>[INST][/INST]</s>", "<", "[", "\\", "<<s>>", "[[INST]]", "é\n</\n"])
def test_escapes(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text
    assert not any(c in e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_chat(spark, empty):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", None]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 40)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant")[t % 2] if c % 3 else rng.choice(roles)
            rows.append((c, t, role, rng.choice([None, "", "</s>[INST] x [/INST]", "word " * rng.randint(1, 60), "é<\\s>" * 9])))
    rows += [(0, 0, "user", "tie"), (None, 1, "user", "q"), (None, None, "assistant", "first"), (50, 0, "assistant", "long " * 5000), (51, 0, "system", "s")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for budget, history in ((120, 40), (100000, 10), (10, 5), (120, 0)):
        formatted = chat.format_conversations(df, budget, history)
        got = {r.conv_id: r for r in chat.digests(formatted).collect()}
        every = formatted.collect()
        for c in {r[0] for r in rows}:
            own = sorted(((-1 if t is None else t), r or "", x or "") for i, t, r, x in rows if i == c)
            said = "".join(f"{r}\n{x}\n" for _, r, x in own)
            target = "".join(x for _, r, x in own if r == "assistant")
            g = got[c]
            assert (g.n_turns, g.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
            assert (g.loss_chars, g.loss_sha256) == (len(target), hashlib.sha256(target.encode()).hexdigest())
            assert g.formatted_chars == sum(len(w.text) for w in every if w.conv_id == c)
        for w in every:
            turns = chat.parse(w.text)
            assert w.over_budget == (w.n_tokens > budget) and (not w.over_budget or len(turns) - w.has_system <= 1)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_history_is_repeated_and_masked():
    count = lambda text: 10
    turns = [("system", "s")] + [(("user", "assistant")[k % 2], f"t{k}") for k in range(9)]
    made = list(chat.windows(iter(turns), 50, 20, count))
    assert [[x for _, x in chat.parse(w["text"])] for w in made] == [["s", "t0", "t1", "t2", "t3"], ["s", "t2", "t3", "t4", "t5"], ["s", "t4", "t5", "t6", "t7"], ["s", "t6", "t7", "t8"]]
    assert [[w["text"][i:j] for i, j in zip(w["loss_spans"][::2], w["loss_spans"][1::2])] for w in made] == [["t1", "t3"], ["t5"], ["t7"], []]
    assert pa.array([w["n_repeated"] for w in made]).to_pylist() == [0, 2, 2, 2]


ODD_TEXTS = ["Aa bB cc dd ee ff gg hh", "", None, "  ", "one", "Ünï cödé grobnik zwamp " * 9, "grobnik " * 40 + "x" * 300, "日本 テキ"]


def test_toxicity_by_hand():
    """Savings, measures and scores from windows that are split, compressed and counted one by one."""
    import zstandard

    model = toxicity.Model(toxicity.MARK + b"grobnik\nzwamp".rjust(40, b"\n"), toxicity.MARK + b"cc dd\nee ff".rjust(40, b"\n"), [-2.0, 0.4, 0.7, 0.3, -0.1])
    level = zstandard.ZstdCompressionParameters.from_level(13, min_match=4, strategy=zstandard.STRATEGY_BTOPT, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(content, data):
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=level).compress(toxicity.MARK + data))

    got = model.measures(pa.array(ODD_TEXTS, pa.string()))
    scores = model.score(got)
    for text, m, score in zip(ODD_TEXTS, got, scores):
        words = WORD.findall(lower(text))
        windows = [f" {' '.join(words[i : i + 6])} ".encode() for i in range(0, len(words), 6)]
        saved = [size(model.ordinary, w) - size(model.toxic, w) for w in windows]
        many = sum(s >= toxicity.SAVING for s in saved)
        want = (max([0, *saved]), many, sum(saved) / len(saved), len(saved)) if saved else (0, 0, 0, 0)
        assert np.allclose(m, want), text
        n = max(1, len(saved))
        x = [1, min(want[0], 12), math.log1p(many), min(many / n, 1) * 4, math.log(n)]
        assert abs(score - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))) < 1e-9
    assert got[:, 1].max() > 0


def test_language_by_hand():
    """Features, margins and decoding with plain integers and lists."""
    dims, langs = 256, ["xa", "xb", "xc"]
    train = ["ung der die", "tion eau les qui", "ando cion los", "keit sch ung", "eau tion", "ez los ando"] * 3
    x = language.features(pa.array(train), dims)
    model = language.Model(x, langs * 6)
    texts = [*ODD_TEXTS, "ung tion", "ANDO der eau", "ung der keit"]
    got = model.predict(pa.array(texts, pa.string()), dims)
    for text, (pred, score, ambiguous, second) in zip(texts, got):
        counts = [0.0] * dims
        for word in WORD.findall(text or ""):
            body = [0, *(b + 32 if 65 <= b < 91 else b for b in word.encode()), 0]
            for order in (1, 2, 3):
                for i in range(len(body) - order + 1):
                    key = order
                    for b in body[i : i + order]:
                        key = (key * 0x9E3779B97F4A7C15 % (1 << 64)) ^ (b + 1)
                    counts[(key * 0xC2B2AE3D27D4EB4F % (1 << 64)) >> 56] += 1
        if not any(c.isalpha() for c in text or ""):
            assert (pred, score) == ("und", 0)
            continue
        norm = math.sqrt(sum(counts))
        margins = [sum(math.sqrt(c) / norm * w for c, w in zip(counts, column)) + b for column, b in zip(model.weights.T.tolist(), model.bias.tolist())]
        loss = {k: sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust.tolist(), margins, code.tolist())) for k, code in zip(langs, model.code)}
        order = sorted(langs, key=loss.get)
        belief = [math.exp((loss[order[0]] - loss[k]) * len(margins)) for k in order]
        assert (pred, second) == (order[0], order[1]), text
        assert abs(score - 1 / sum(belief)) < 1e-3 and ambiguous == (loss[second] - loss[pred] < language.MARGIN * (loss[second] + loss[pred]))
    # a text that is half one language and half another is told to be so, and one of a single language is not
    mixed, pure = got[len(ODD_TEXTS)], got[-1]
    assert {mixed[0], mixed[3]} == {"xa", "xb"} and mixed[2]
    assert pure[:1] == ("xa",) and not pure[2]


def test_samples_are_bounded_and_even(spark):
    """A text with thousands of copies is one text of the sample, and leaves room for the others."""
    rows = [(i, "copy of a copy", "xa", 0) for i in range(3000)] + [(5000 + i, f"own text {i} {'abc'[i % 3]}", "xa", i % 2) for i in range(50)] + [(6000 + i, f"ein text {i}", "xb", 0) for i in range(30)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, toxic int, draw double").repartition(4)
    seen = []
    old = language.Model
    try:
        language.Model = lambda x, labels: seen.append(labels) or old(x, labels)
        language.fit(docs, per_language=20)
        language.fit(docs)
    finally:
        language.Model = old
    assert [(s.count("xa"), s.count("xb")) for s in seen] == [(20, 20), (51, 30)]
    labels = docs.select("doc_id", "toxic")
    taken, train = [], toxicity.train
    try:
        toxicity.train = lambda *a: taken.append(a) or train(*a)
        toxicity.fit(docs, labels, per_class=5000)
        toxicity.fit(docs, labels, per_class=10, class_bytes=60)
    finally:
        toxicity.train = train
    assert [(len(t), len(o)) for t, o, _, _ in taken][0] == (25, 56) and all(len(t) == len(set(t)) for t, *_ in taken)
    assert all(0 < sum(len(t.encode()) for t in x) <= 60 for x in taken[1][:2]) and taken[1][2:] == (25, 3055)


def test_odd_rows(spark):
    """Repeated rows, an id with two texts, and null ids each give their own rows, equal where the texts are."""
    from blockframe.llm import fertility, packing

    text = " ".join(f"word{i % 37} und der" for i in range(60))
    rows = [(1, text), (1, text), (1, "another text"), (None, text), (None, None), (2, ""), (None, None)]
    docs = spark.createDataFrame([(*r, False, "xa") for r in rows], "doc_id long, text string, held_out boolean, lang string").repartition(2)
    model = language.fit(docs)
    tox = toxicity.Model(toxicity.MARK + b"und der".rjust(30), toxicity.MARK + b"word".rjust(30), [0.0, 0.1, 0.1, 0.1, 0.0])
    found = {
        "op1": (toxicity.score(docs, tox), "score"),
        "op2": (recurrent.score(docs.select("doc_id", "text", "held_out")), "score"),
        "op3": (fertility.quality(docs), "n_words"),
        "op4": (language.identify(docs, model), "lang_pred"),
        "op5": (packing.pack(docs), "ids_crc32"),
    }
    for name, (df, column) in found.items():
        got = sorted(((r.doc_id, r[column]) for r in df.collect()), key=str)
        assert sorted((i for i, _ in got), key=str) == sorted((i for i, _ in rows), key=str), name
        # the three copies of the text agree, and so do the three empty ones
        values = sorted((str(v) for _, v in got))
        assert sorted(values.count(v) for v in set(values))[-1] >= 3, name


def test_clashing_columns_of_small_tables(spark):
    """Conversations, benchmark items and labels with columns named as those that the operators make."""
    from blockframe.llm import decontamination

    turns = spark.createDataFrame([(1, 0, "user", "a", 5, "w"), (1, 1, "assistant", "b", 6, None), (2, 0, None, None, 7, "w")], "conv_id int, turn int, role string, text string, window int, n_turns string")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    assert got[1].n_turns == 2 and got[1].loss_chars == 1 and got[2].n_turns == 1
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    docs = spark.createDataFrame([(1, "x a b c d e f g h y"), (2, "z")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c d e f g h", 1, "s", 2)], "item_id string, text string, row int, spans string, doc_id int")
    assert {r.doc_id: r.n_hit for r in decontamination.contamination(docs, bench).collect()} == {1: 8, 2: 0}
    labels = spark.createDataFrame([(1, 1, "t", 2.0, 3), (2, 0, "t", 2.0, 3)], "doc_id long, toxic int, text string, score double, name int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 2
