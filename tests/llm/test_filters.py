import hashlib
import io
import math

import numpy as np
import pyarrow as pa
import pytest
from helpers import base_rules, classes, contamination, fingerprint, removals

from blockframe.llm import archives, decontamination, fertility, fmindex, packing, simhash, substrings


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_quality(spark, corpus, empty):
    text = dict(pairs(corpus))
    rows = fertility.quality(corpus).collect()
    assert len(rows) == len(text) and fertility.quality(empty).count() == 0
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_rules(text[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
        assert (r.piece_chars is None) == (r.n_words == 0)
    kept = fertility.keep_quality(corpus)
    assert kept.schema == corpus.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_quality_bands_reject():
    strict = {**fertility.BANDS, "latin": fertility.Band(piece_chars=(50.0, 60.0))}
    parts = ("con", "struct", "able", "mo", "tion", "light", "er", "past", "un", "form")
    text = pa.array([" ".join(parts[i % 10] + parts[(i * 7 + i // 10) % 10] for i in range(80))])
    assert fertility.measure(text)["kept"][0] and not fertility.measure(text, bands=strict)["kept"][0]
    assert fertility.SCRIPTS[fertility.measure(pa.array(["Это русский текст"]))["script"][0]] == "cyrillic"
    bytes_only = fertility.measure(pa.array(["\U0001f9ff\U0001f9ff \U0001f9ff"]))
    assert bytes_only["fallback_share"][0] > 0.5


def test_bands_come_from_the_corpus(spark):
    """Bands of languages, of scripts for unknown languages, and verdicts, against plain Python over the measures."""
    import random

    rng = random.Random(4)
    sound = ("con", "struct", "able", "mo", "tion", "light", "er", "past", "un", "form")
    rows = []
    for i in range(700):
        lang = ("aa", "bb", None, "rare")[0 if i < 300 else 1 if i < 600 else 2 if i < 690 else 3]
        junk = i % 50 == 7
        part = lambda: "".join(rng.choice(sound) for _ in range(2 if lang == "aa" else 3)) + ("#$%" if junk else "")  # noqa: E731, B023
        rows.append((i, " ".join(part() for _ in range(120)), lang, 1.5, "s"))
    rows += [(700, "Это русский текст " + " ".join("слово" + "абвгд"[k % 5] + "еёжзи"[k // 5 % 5] + "клмно"[k // 25 % 5] for k in range(60)), "aa", 0.0, "s"), (701, None, "aa", 0.0, "s"), (702, "", None, 0.0, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, low double, script string").repartition(3)
    got = {r.doc_id: r for r in fertility.quality(docs).collect()}
    lang = {i: k for i, _, k, _, _ in rows}
    inner = lambda r: fertility.measure(pa.array([rows[r.doc_id][1]], pa.string()))["kept"][0]
    sound_ids = [i for i, r in got.items() if inner(r)]

    def edge(ids, name):
        x = np.sort([math.floor(getattr(got[i], name) * 1000) for i in ids]) / 1000
        a, mid, b = (x[math.ceil(q * len(x)) - 1] for q in (0.25, 0.5, 0.75))
        reach = fertility.WIDE * max((b - a) / 1.349, fertility.FLOOR * mid)
        return (0.0, max(mid + reach, fertility.FALLBACK)) if name == "fallback_share" else (mid - reach, mid + reach)

    for i, r in got.items():
        own = [j for j in sound_ids if got[j].script == r.script and lang[j] == lang[i]]
        every = [j for j in sound_ids if got[j].script == r.script]
        group = own if lang[i] and len(own) >= fertility.LEAST else every if len(every) >= fertility.LEAST else None
        want = i in sound_ids and (group is None or all(a <= getattr(r, c) <= b for c in fertility.MEASURES for a, b in [edge(group, c)]))
        assert r.kept == want, i
    junk = [i for i in range(700) if i % 50 == 7 and lang[i] in ("aa", "bb")]
    assert not any(got[i].kept for i in junk)
    assert sum(got[i].kept for i in range(600)) > 0.97 * (600 - len(junk)) and got[700].kept and not got[701].kept
    kept = fertility.keep_quality(docs)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == sorted(x for x in rows if got[x[0]].kept)


def test_bands_reject_junk_and_keep_clean_text(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = fertility.quality(spark.read.parquet(f"{folder}/documents.parquet")).where("NOT base_failed").join(labels, "doc_id").collect()
    clean, junk = ([r.kept for r in rows if r.quality == k] for k in (1, 0))
    assert len(junk) > 200 and np.mean(junk) < 0.4
    assert len(clean) > 2000 and np.mean(clean) > 0.97


def test_repeated_windows_with_large_codes():
    codes = np.array([1 << 30, 5, 7, 9, 1 << 30, 5, 7])
    assert fertility.repeated_window_words(codes) == 6


def test_packing(spark, corpus, empty):
    text = dict(pairs(corpus))
    rows = packing.pack(corpus).collect()
    assert packing.pack(empty).count() == 0
    encode = packing.encoder(None).encode
    sequences = {}
    for i, t in text.items():
        ids = [*encode([t or ""])[0], 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == r.piece * 2048 and len(part) == r.length
            import zlib

            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_bin_completion_is_exact_on_small_cases():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(25):
        items = rng.integers(1, 20, 8).tolist()
        counts = np.bincount(items, minlength=25)

        def fits(k):
            def place(rest, bins):
                if not rest:
                    return True
                return any(place(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1 :]]) for i in range(len(bins)) if bins[i] >= rest[0] and bins[i] not in bins[:i])

            return place(sorted(items, reverse=True), [24] * k)

        best = next(k for k in itertools.count(1) if fits(k))
        runs = packing.bin_completion(counts, 24)
        used = np.zeros(25, int)
        for fill, times in runs:
            assert sum(fill) <= 24
            for n in fill:
                used[n] += times
        assert (used == counts).all() and sum(t for _, t in runs) == best


def optimum(items, capacity, below):
    """Fewest sequences, by trying all ways to place the items."""

    def fits(rest, bins):
        return not rest or any(fits(rest[1:], [*bins[:i], bins[i] - rest[0], *bins[i + 1 :]]) for i in range(len(bins)) if bins[i] >= rest[0] and bins[i] not in bins[:i])

    k = below
    while k > 1 and fits(sorted(items, reverse=True), [capacity] * (k - 1)):
        k -= 1
    return k


def test_bin_completion_beats_best_fit():
    """Cases on which best fit is not optimal: the search must find what brute force finds."""
    rng, better = np.random.default_rng(3), 0
    while better < 12:
        items = rng.integers(4, 14, 9).tolist()
        counts = np.bincount(items, minlength=25)
        greedy = sum(t for _, t in packing.best_fit(counts, 24))
        if greedy > packing.lower_bound(counts, 24):
            best = optimum(items, 24, greedy)
            assert packing.lower_bound(counts, 24) <= best
            assert sum(t for _, t in packing.bin_completion(counts, 24)) == best
            better += best < greedy


@pytest.mark.parametrize("seed", [1, 2])
def test_bin_completion_of_short_documents(seed):
    counts = np.bincount(np.random.default_rng(seed).integers(100, 251, 3000), minlength=2049)
    bound, total = packing.lower_bound(counts, 2048), int((counts * np.arange(2049)).sum())
    assert bound == -(-total // 2048) < sum(t for _, t in packing.best_fit(counts, 2048))
    runs = packing.bin_completion(counts)
    assert sum(t for _, t in runs) == bound
    used = np.zeros(2049, int)
    for fill, times in runs:
        assert sum(fill) <= 2048
        np.add.at(used, list(fill), times)
    assert (used == counts).all()


def test_fillings_are_the_undominated_ones():
    """Against all fillings: one is dominated if some pieces of it, or its waste, can give way to one that is left over."""
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(40):
        items, room = sorted(rng.integers(1, 12, 7).tolist(), reverse=True), 15
        every = {tuple(f) for k in range(8) for f in itertools.combinations(items, k) if sum(f) <= room}
        want = set()
        for f in every:
            left = list(items)
            for n in f:
                left.remove(n)
            swaps = [(sum(c), k) for k in range(len(f) + 1) for c in itertools.combinations(f, k)]
            if not any(s < x <= s + room - sum(f) or (x == s and k > 1) for x in left for s, k in swaps):
                want.add(f)
        got = list(packing.fillings(np.bincount(items, minlength=16), room))
        assert {f for _, f in got} == want and len(got) == len(want)
        assert [w for w, _ in got] == sorted(room - sum(f) for _, f in got)


def test_archives(spark, tmp_path):
    big, page = "<p>" + "é" * 200, "https://a.example/ x%20\n"
    rows = [(1, page, big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "v", "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\n"), (6, "v", "short"), (7, "w", "short"), (2, None, big), (None, "n", big), (8, "z", "y" * 3_000_000)]
    clashing = [(*r, "a", 1, b"d", "f") for r in rows]
    pages = spark.createDataFrame(clashing, "page_id long, url string, html string, arc string, first int, digest binary, value string").repartition(2)
    for version in (1, 2, None):
        path = f"file://{tmp_path}/v{version}"
        archives.archive(pages, path, segment_bytes=2000, version=version)
        got = sorted(archives.read_records(spark, path).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
        assert [r.page_id for r in got] == [1, 2, 2, 3, 4, 5, 6, 7, 8, None]
        for r in got:
            html = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(html), hashlib.sha256(html).hexdigest())
            assert r.block_digest_ok and r.date == f"2024-01-01T00:00:0{r.page_id or 0}Z" and r.record_id.startswith("urn:uuid:")
        by = {r.page_id: r for r in got}
        assert by[1].record_type == "response" and by[1].refers_to is None
        assert by[2].record_type == by[None].record_type == "revisit" and by[2].refers_to == 1 and by[2].refers_to_id == by[1].record_id
        assert by[6].record_type == by[7].record_type == by[3].record_type == "response"
        assert by[1].target_uri.startswith("https://a.example/ x%20") and by[2].target_uri == "unknown:"
    none = f"file://{tmp_path}/none"
    archives.archive(pages.limit(0), none)
    assert archives.read_records(spark, none).count() == 0


def test_arc_files(spark, tmp_path):
    import gzip

    bodies = [b"one\n\nURL IP 3", b"", b"two \x00\xff"]
    for version in (1, 2):
        data = archives.arc_version_block(version) + b"".join(archives.arc_record(version, f"http://h/{i} a", "20200102030405", b) for i, b in enumerate(bodies)) + b"\n"
        assert [(r.url, r.body) for r in archives.read_arc(io.BytesIO(data))] == [(f"http://h/{i} a", b) for i, b in enumerate(bodies)]
        (tmp_path / f"{version}.arc.gz").write_bytes(gzip.compress(data[:50]) + gzip.compress(data[50:]))
    (tmp_path / "3.arc").write_bytes(archives.arc_version_block(1) + archives.arc_record(1, "http://h/p", "202001020304", b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nb\xffdy") + archives.arc_record(1, "dns:h", "20200102030405", b"h. 300 IN A 1.2.3.4", "text/dns"))
    archives.convert_files(spark, f"file://{tmp_path}/*.gz", f"file://{tmp_path}/warc", segment_bytes=100)
    archives.convert_files(spark, f"file://{tmp_path}/3.arc", f"file://{tmp_path}/more")
    got = [(r.record_type, r.target_uri, r.date, r.payload_digest) for r in archives.read_records(spark, f"file://{tmp_path}/warc").collect() if r.block_digest_ok]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    records = [("resource", f"http://h/{i} a", "2020-01-02T03:04:05Z", digest(b)) for i, b in enumerate(bodies)]
    assert sorted(x for x in got if x[0] == "resource") == sorted(2 * records) and sum(x[0] == "warcinfo" for x in got) == 2 and len(got) == 8
    more = {r.record_type: r for r in archives.read_records(spark, f"file://{tmp_path}/more").collect()}
    assert more["response"].payload_digest == digest(b"b\xffdy") and more["response"].date == "2020-01-02T03:04:00Z" and more["response"].payload_bytes == 4
    assert more["resource"].target_uri == "dns:h" and more["resource"].payload_bytes == 19 and "warcinfo" in more
    assert archives.warc_time("202001020304") == "2020-01-02T03:04:00Z"
    for bad in (data[:-9], b"x y\n", b"http://a 0 1 t 3\nabc", data.replace(b"2 0 block", b"9 0 block")):
        with pytest.raises(archives.ArchiveError):
            list(archives.read_arc(io.BytesIO(bad)))


def test_fm_index_matches_brute_force():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 300)
    text[rng.integers(0, 300, 15)] = text[-1] = 0
    stream = rng.integers(0, 6, 400)
    index = fmindex.FMIndex(text)
    ends = np.arange(1, 401)
    length, lo, hi = index.matching(stream, ends, 9)
    all_, s = text.tolist(), stream.tolist()
    for e, n, a, b in zip(ends.tolist(), length.tolist(), lo.tolist(), hi.tolist()):
        best = 0
        while best < min(9, e) and 0 not in s[e - best - 1 : e] and any(all_[i : i + best + 1] == s[e - best - 1 : e] for i in range(300)):
            best += 1
        assert n == best
        if n:
            assert sorted(index.order[a:b].tolist()) == [i for i in range(300) if all_[i : i + n] == s[e - n : e]]
    with pytest.raises(ValueError):
        index.matching(stream, ends, 16)


@pytest.mark.parametrize("hot", [500, 1])
def test_substrings(spark, corpus, empty, hot):
    docs = pairs(corpus)
    want = removals(docs)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.removals(corpus, hot=hot, bucket_bytes=5000, shard_bytes=5000).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 100
    assert substrings.removals(empty).count() == 0
    cut = substrings.cut_texts(corpus)
    assert cut.schema == corpus.schema
    left = {r.doc_id: r for r in cut.collect()}
    for i, t in docs:
        words, gone, sha = want[i]
        if words and gone == words:
            assert i not in left
        else:
            assert hashlib.sha256(b" ".join((left[i].text or "").encode().split())).hexdigest() == sha
            assert gone or left[i].text == t


def test_substrings_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(None, text), (None, text + " z"), (5, text), (5, text), (5, "q " + text), (9, text)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.removals(docs).collect())
    assert got == [(False, 5, 20, 0), (False, 5, 20, 0), (False, 5, 21, 0), (False, 9, 20, 20), (True, 0, 20, 20), (True, 0, 21, 20)]


def test_simhash(spark, corpus, empty):
    docs = pairs(corpus)
    prints = {i: fingerprint(t) for i, t in docs}
    want = classes(prints)
    for per_task in (1 << 15, 8):
        got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(corpus, per_task=per_task).collect()}
        assert got == {i: (prints[i], want[i]) for i in prints}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(corpus)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_simhash_odd_rows(spark):
    """Repeated rows, an id with two texts, null ids; a hot fingerprint; an odd radius."""
    one, other = "a b c d e f", "q r s t u v w"
    rows = [(5, one), (5, one), (5, other), (2, other), (None, one), (None, None)] + [(100 + k, "the same") for k in range(300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int").repartition(5)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    # null texts have fingerprint zero and are alone here
    assert got == sorted([(False, 5, 5)] * 2 + [(False, 5, 2), (False, 2, 2), (True, 0, 5), (True, 0, None)] + [(False, 100 + k, 100) for k in range(300)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert kept == sorted([(5, one), (2, other), (None, one), (None, None), (100, "the same")], key=str)
    similar = sorted(((r.doc_id, r.text) for r in simhash.keep_similar(docs).collect()), key=str)
    assert similar == kept
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, radius=3)


def test_hot_neighbours(spark):
    """A star, a chain and single links: components with keys that are broadcast and keys that are not."""
    star = [(0, k) for k in range(1, 400)]
    chain = [(k, k + 1) for k in range(1000, 1030)]
    edges = spark.createDataFrame(star + chain + [(2000, 2001), (2001, 2001)], "a long, b long").repartition(3)
    label = {r.node: r.label for r in simhash.components(edges).collect()}
    assert label == {k: 0 for k in range(400)} | {k: 1000 for k in range(1000, 1031)} | {2000: 2000, 2001: 2000}


def test_simhash_plans_stay_small(spark, corpus, monkeypatch):
    """No plan of theirs holds a step many times over: such plans fill the driver's memory where there are many partitions."""
    sizes = []

    def plan_size(df):
        sizes.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return df

    write = simhash.written
    monkeypatch.setattr(simhash, "written", lambda df: write(plan_size(df)))
    plan_size(simhash.near_duplicates(corpus))
    plan_size(simhash.keep_similar(corpus))
    assert len(sizes) > 10 and max(sizes) <= 20, sizes


def test_similar_pairs_are_verified(spark):
    """Chains of edits: classes are exactly those of pairs of similarity 0.8 or more, where these meet."""
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = {}
    for k in range(60):
        words = [word() for _ in range(400)]
        texts[10 * k] = words
        for c in range(1, 4):
            near = list(words)
            for at in rng.sample(range(400), rng.randint(4, 16)):
                near[at] = word()
            texts[10 * k + c] = near
    grams = {i: {tuple(w[j : j + 5]) for j in range(396)} for i, w in texts.items()}
    similarity = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in texts for b in texts if a < b and a // 10 == b // 10}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), s in similarity.items():
        if s >= 0.8:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    assert sum(0.7 < s < 0.8 for s in similarity.values()) > 20
    # nothing is joined that exact classes keep apart, and few links are missed
    assert all(find(i) == find(c) for i, c in got.items())
    close = [got[a] == got[b] for (a, b), s in similarity.items() if 0.8 <= s < 0.85]
    assert len(close) > 20 and sum(close) / len(close) >= 0.9


def test_ball_links_are_complete(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base[:8].tolist():
        for _ in range(25):
            for k in rng.integers(0, 64, int(rng.integers(1, 7))).tolist():
                b ^= 1 << k
            prints.add(b)
    prints = sorted(prints)
    want = classes({i: f for i, f in enumerate(prints)})
    for bits, per_task in ((0, 1 << 20), (5, 64)):
        df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in prints], "fp long").repartition(3)
        label = {r.node & (1 << 64) - 1: r.label for r in simhash.components(simhash.links(df, per_task=per_task)).collect()}
        got = {}
        for i, f in enumerate(prints):
            got.setdefault(label.get(f, ("alone", f)), []).append(i)
        assert sorted(got.values()) == sorted([i for i in want if want[i] == c] for c in set(want.values()))


def test_similar_classes(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    for k in range(30):
        words = [word() for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            near = list(words)
            for at in rng.sample(range(300), 4):
                near[at] = word()
            rows.append((10 * k + c, " ".join(near)))
        rows.append((10 * k + 5, " ".join(words[:150] + [word() for _ in range(150)])))
    rows += [(1000, None), (1001, ""), (1001, ""), (None, "a"), (None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.similar_classes(docs).collect()}
    assert all(got[10 * k + c] == 10 * k for k in range(30) for c in range(4))
    assert all(got[10 * k + 5] == 10 * k + 5 for k in range(30))
    assert got[1000] == got[1001] == 1000
    kept = simhash.keep_similar(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted([(False, 10 * k + c) for k in range(30) for c in (0, 5)] + [(False, 1000), (True, 0), (True, 0)])


@pytest.mark.parametrize("block_bytes", [16 << 20, 300])
def test_decontamination(spark, corpus, empty, block_bytes):
    docs = pairs(corpus)
    text = dict(docs)
    pick = lambda i, a, n: " ".join(text[i].split()[a : a + n])
    items = [("a", pick(3, 2, 15)), ("b", "".join(c.upper() if c < "\x7f" else c for c in pick(3, 20, 9))), ("c", "ONE"), ("d", None), ("e", ""), ("f", pick(6, 0, 12) + " other " + pick(7, 0, 12)), ("a", pick(9, 0, 10)), (None, pick(1, 0, 8)), ("g", "ka ka ka ka ka ka ka ka ka")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    # rows of one id are one item, and a null id is the empty text
    want = contamination(docs, [(i or "", t) for i, t in items])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(corpus, bench, block_bytes=block_bytes).collect()}
    assert got == want and any(x[4] for x in want.values())
    kept = decontamination.drop_contaminated(corpus, bench, block_bytes=block_bytes)
    assert set(kept.columns) == set(corpus.columns) and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[4]}
    assert decontamination.contamination(empty, bench, block_bytes=block_bytes).count() == 0
    assert decontamination.contamination(corpus, bench.limit(0)).where("n_items > 0").count() == 0


@pytest.mark.parametrize("min_items", [1, 2])
def test_decontamination_judges_rows(spark, min_items):
    """Rows with a repeated id or none are judged by their own text, however many blocks the items take."""
    leak, other, clean = "w1 w2 w3 w4 w5 w6 w7 w8 w9", "v1 v2 v3 v4 v5 v6 v7 v8", "c1 c2 c3"
    rows = [(1, f"x {leak}"), (1, clean), (None, f"{other} y {leak}"), (None, clean), (2, None), (3, f"{leak}"), (3, f"{leak}")]
    docs = spark.createDataFrame([(*r, "d", 1) for r in rows], "doc_id long, text string, row string, spans int")
    bench = spark.createDataFrame([("a", leak), ("b", leak.upper()), ("c", other), ("a", None), (None, "")], "item_id string, text string")
    # the first and the last texts hold two items, a and b
    want = sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    kept = [decontamination.drop_contaminated(docs, bench, min_items=min_items, block_bytes=size) for size in (16 << 20, 10)]
    assert [sorted(((r.doc_id, r.text) for r in k.collect()), key=str) for k in kept] == [want, want]
    assert all(k.columns == docs.columns for k in kept)
    one = bench.where("item_id = 'a'")
    wide = sorted(((r.doc_id, r.text) for r in decontamination.drop_contaminated(docs, one, min_items=min_items, block_bytes=10).collect()), key=str)
    assert wide == (want if min_items == 1 else sorted(rows, key=str))


def test_decontamination_index_of_a_full_block():
    """16 MB of items take some hundred MB, not a Python object a window."""
    import pickle
    import random
    import tracemalloc

    from helpers import CLEAN

    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(20000)]
    items = [(str(k), " ".join(rng.choices(vocab, k=400))) for k in range(600)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    index = decontamination.Index(items, lambda words: np.arange(len(words)), 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * size and len(pickle.dumps(index)) < 8 * size
    text = "x " + " ".join(CLEAN.findall(items[7][1])[50:60]) + " y"
    n, spans, found = decontamination._occurrences(pa.array([text, None, ""]), index)
    assert n.tolist() == [12, 0, 0] and spans == [[1, 11], [], []] and found == [["7"], [], []]


def test_fertility_measures_by_hand(corpus):
    """The four measures from each vocabulary's own encoder, word by word."""
    import base64
    from collections import Counter

    import public_tokenizers
    import sentencepiece
    import tiktoken
    from helpers import WORD

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    byte = tiktoken.Encoding("test", pat_str=r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=ranks, special_tokens={})
    texts = [t for _, t in pairs(corpus)] + ["Это русский текст", "Ελληνικό κείμενο", "نص عربي هنا", "\U0001f9ff\U0001f9ff a"]
    m = fertility.measure(pa.array(texts, pa.string()))
    for d, text in enumerate(texts):
        words = WORD.findall(text or "")
        if not words:
            continue
        ids = [i for w in words for i in piece.encode(w)]
        chars = sum(map(len, words))
        share = [c / len(ids) for c in Counter(ids).values()]
        want = (chars / len(ids), chars / sum(len(byte.encode_ordinary(" " + w)) for w in words), sum(piece.is_byte(i) for i in ids) / len(ids), -sum(p * math.log2(p) for p in share))
        assert np.allclose([m[c][d] for c in fertility.MEASURES], want), text
    assert [fertility.SCRIPTS[k] for k in m["script"][-4:]] == ["cyrillic", "greek", "arabic", "other"]


def test_texts_beyond_a_slice(spark):
    """Texts of 5 MB, more than any slice or block holds: every word counts."""
    text = " ".join(f"w{i}" for i in range(700_000))
    rows = [(1, text), (2, "x " + text), (3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(text) > 5_000_000
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.removals(docs).collect()}
    assert got == {1: (700_000, 0), 2: (700_001, 700_000), 3: (1, 0)}
    bench = spark.createDataFrame([("a", " ".join(f"w{i}" for i in range(699_990, 700_000)))], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.contamination(docs, bench).collect()}
    assert found == {1: (700_000, 10), 2: (700_001, 10), 3: (1, 0)}
    prints = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.near_duplicates(docs).collect()}
    assert prints == {i: fingerprint(t) for i, t in rows}
    assert sorted(r.doc_id for r in simhash.keep_similar(docs).collect()) == [1, 3]
