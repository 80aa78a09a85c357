import pytest


@pytest.fixture()
def corpus(spark):
    """A small corpus with every awkward kind of row; some columns clash with names that operators use."""
    import random

    rng = random.Random(5)
    vocab = [a + b for a in ("ka", "lo", "mi", "éu", "Ta", "ner") for b in ("n", "rr", "sö", "", "x.", "ment")]
    line = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = line(40)
    rows = []
    for i in range(30):
        text = "\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(1, 8)))
        if i % 3 == 0:
            text += "\n" + passage + " " + line(5)
        rows.append((i, text))
    rows += [(30, rows[4][1]), (31, rows[4][1]), (32, rows[5][1].replace("ka", "kä", 1)), (33, None), (34, ""), (35, " \t\n "), (36, "one"), (37, line(6000)), (38, "a b c " * 200), (39, "### $$$ %%% " * 30), (40, "日本語 テキスト 。 " * 20), (41, "x" * 5000), (42, "\x00 \x85   <|endoftext|> </s>[INST]")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, starts string, key string, row string, data binary"
    full = [(i, t, None if i % 7 == 0 else ("aa" if i % 2 else "bb"), None, None if t is None else len(t), "f", "s", "k", "r", b"d") for i, t in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
