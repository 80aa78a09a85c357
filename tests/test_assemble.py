import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockframe import assemble
from blockframe.functions import REGISTRY
from blockframe.operators.breaks import class_breaks, natural_breaks
from blockframe.plans.model import PlanError

FIRST = 301  # January 1995


def tables(spark, values, blocks, entities=None, kind="double"):
    """A live table of entities by blocks, and a table of one value per entity and month."""
    entities = sorted(entities or {k for k, _ in values})
    live = spark.createDataFrame([(k, b) for k in entities for b in blocks], "id long, block int")
    rows = [(i, k, f"{1970 + (t - 1) // 12}-{(t - 1) % 12 + 1:02d}-15", v) for i, ((k, t), v) in enumerate(sorted(values.items()))]
    facts = spark.createDataFrame(rows, f"id long, customer long, at string, amount {kind}")
    config = {"customer": {"key": "id", "date_key": "block"}, "fact": {"key": "id", "pointers": {"customer": "customer.id"}, "order_by": ["id"]}}
    return {"customer": live, "fact": facts}, config


def run(spark, features, values, blocks, last="1999-12-05", **options):
    kind = options.pop("kind", "double")
    entities = options.pop("entities", None)
    data, config = tables(spark, values, blocks, entities, kind)
    df = assemble(features, data, config, {"customer": "customer.id", "block": ["1995-01-01", last]}, display=False, **options)
    return {(r["customer"], r["block"]): r for r in df.collect()}


X = "Fact.LATEST(amount|customer,DATE(at))"


# the golden cases' numbers and truth values are fixed values
def test_window_sum_golden(spark):
    given = [None, 1, 3, 0, 0, None, None, 1, None, None, 2, 3, -2, 0, 0, 0]
    expected = [None, 1, 4, 3, 0, 0, None, 1, 1, None, 2, 5, 1, -2, 0, 0]
    values = {(7, FIRST + i): float(v) for i, v in enumerate(given) if v is not None}
    got = run(spark, [f"WINDOW_SUM({X},2)"], values, [FIRST + i for i in range(16)])
    assert [got[7, FIRST + i][0] for i in range(16)] == [v or 0 for v in expected]


@pytest.mark.parametrize(
    "n, expected",
    [
        (2, [True, False, False, False, True, True, False, True, True, True, True, False, False, False, False]),
        (3, [True, False, False, True, True, True, True, True, True, True, True, False, False, False, False]),
    ],
)
def test_future_within_golden(spark, n, expected):
    given = [1, 3, 0, 0, 0, 0, 1, None, None, 2, 3, -2, 0, 0, 0]
    values = {(7, FIRST + i): float(v) for i, v in enumerate(given) if v is not None}
    got = run(spark, [f"FUTURE_WITHIN({X},{n})"], values, [FIRST + i for i in range(15)])
    assert [got[7, FIRST + i][0] for i in range(15)] == expected


def model(values, blocks, entities):
    """The sequence functions, block by block, in plain Python."""
    out = {}
    for k in entities:
        mine = {t: v for (e, t), v in values.items() if e == k}
        on_grid = {t: mine.get(t) for t in blocks}
        absent = not mine
        for i, t in enumerate(blocks):
            past, before = blocks[: i + 1], blocks[:i]
            seen = [b for b in past if on_grid[b]]
            nonnull = [b for b in past if on_grid[b] is not None]
            window = [on_grid[b] for b in past if b > t - 3]
            v = on_grid[t]
            prior = [b for b in before if on_grid[b]]
            r = {
                "ACCUMULATE({})": sum(on_grid[b] or 0 for b in past),
                "ACCUMULATE({},3)": sum(on_grid[b] or 0 for b in past[-3:]),
                "TIME_SINCE_SEEN({})": i - blocks.index(seen[-1]) if seen else -999,
                "FUTURE_UNTIL({})": i - blocks.index(nonnull[-1]) if nonnull else -999,
                "FUTURE_WITHIN({},3)": any(on_grid[b] for b in blocks if t < b <= t + 3),
                "WINDOW_SUM({},3)": sum(x for x in window if x is not None),
                "WINDOW_FIRST({},3)": next((x for x in window if x), 0),
                "WINDOW_LAST({},3)": next((x for x in reversed(window) if x), 0),
                "WINDOW_COUNT_NOTNA({},3)": sum(bool(x) for x in window),
                "STREND({})": (v or 0) - sum(on_grid[b] or 0 for b in before[-5:]) / 5,
                "TREND_DIFF({},2)": (v or 0) - (on_grid.get(t - 2) or 0),
                "CP_CHANGED({})": bool(v) and not (prior and on_grid[prior[-1]] == v),
                "FIRST({})": on_grid[seen[0]] if seen else 0,
                "LAST({})": on_grid[seen[-1]] if seen else 0,
                "LAST_BEFORE({})": on_grid[prior[-1]] if prior else 0,
                "SHIFT({},1)": mine.get(t - 1) or 0,
                "MINUSPREV({})": (mine.get(t) or 0) - (mine.get(t - 1) or 0),
                "ACC({})": sum(x or 0 for s, x in mine.items() if t - len(blocks) <= s <= t) if t < blocks[-1] else mine.get(t) or 0,
            }
            if absent:
                r |= {"TIME_SINCE_SEEN({})": -999, "FUTURE_UNTIL({})": -999, "STREND({})": -99999}
            out[k, t] = r
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_sequences_against_a_model(spark, seed):
    rng = random.Random(seed)
    blocks = [b for b in range(FIRST, FIRST + 14) if rng.random() < 0.8]
    values = {(k, t): rng.choice([None, 0.0, 0.0, 1.0, 2.0, -3.0]) for k in range(12) for t in range(FIRST - 3, FIRST + 16) if rng.random() < 0.4}
    entities = list(range(13))  # the last has no rows
    expected = model(values, blocks, [k for k in entities])
    names = list(next(iter(expected.values())))
    got = run(spark, [n.format(X) for n in names], values, blocks, entities=entities)
    assert got.keys() == expected.keys()
    for key, row in expected.items():
        for i, n in enumerate(names):
            assert math.isclose(got[key][i], row[n], abs_tol=1e-9), (key, n, got[key][i], row[n])


def test_texts_and_fills(spark):
    values = {(1, FIRST): "", (1, FIRST + 1): "x", (1, FIRST + 3): "y"}
    got = run(spark, [f"LAST({X})", f"CP_CHANGED({X})", f"LAST_BEFORE({X})"], values, range(FIRST, FIRST + 5), kind="string", entities=[1, 2])
    assert [tuple(got[1, FIRST + i])[:3] for i in range(5)] == [("0", False, "0"), ("x", True, "0"), ("x", False, "x"), ("y", True, "x"), ("y", False, "y")]
    assert tuple(got[2, FIRST])[:3] == ("0", False, "0")


def test_nan_is_null(spark):
    got = run(spark, ["Fact.SUM(amount|customer,DATE(at))", "Fact.COUNT(amount|customer,DATE(at))"], {(1, FIRST): float("nan"), (2, FIRST): 2.0}, [FIRST])
    assert tuple(got[1, FIRST])[:2] == (0.0, 0) and tuple(got[2, FIRST])[:2] == (2.0, 1)


def test_features_do_not_depend_on_order(spark):
    values = {(k, FIRST + k): float(k) for k in range(1, 4)}
    alone = run(spark, [f"STREND({X})"], values, range(FIRST, FIRST + 6), entities=[1, 2, 3, 9])
    after = run(spark, [X, f"STREND({X})"], values, range(FIRST, FIRST + 6), entities=[1, 2, 3, 9])
    assert {k: r[0] for k, r in alone.items()} == {k: r[1] for k, r in after.items()}


def test_rank_is_the_average_percentile(spark):
    pandas = pytest.importorskip("pandas")
    rng = random.Random(3)
    values = {(k, FIRST): rng.choice([-1.0, 0.0, 0.5, 3.0, 3.0, 1e9]) for k in range(40)}
    got = run(spark, [f"RANK({X})"], values, [FIRST])
    s = pandas.Series({k: v if v >= 0 else None for (k, _), v in values.items()}).rank(pct=True)
    for k, r in s.items():
        assert math.isclose(got[k, FIRST][0], r if r == r else 0.0, abs_tol=1e-9)


def test_errors(spark):
    values, blocks = {(1, FIRST): 1.0}, [FIRST]
    for bad in ("Fact.NOTHING(amount|customer)", "Fact.SUM(amount)", "Fact.SUM(amount,id|customer)", "Nowhere.SUM(ab|cd)", "ACCUMULATE(Fact.SUM(amount|customer))", "Fact.SUM(amount|id)", "Fact.ACCUMULATE(amount)", "amount", "PEOPLE_GENDER(customer.id)", "GREATERTHAN(customer.id,'x')"):
        with pytest.raises(PlanError):
            run(spark, [bad], values, blocks)
    data, config = tables(spark, values, blocks)
    out = {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}
    with pytest.raises(ValueError):
        assemble([X], data, config, out, "year")
    with pytest.raises(PlanError):
        assemble([X], data, config, {"customer": "customer.id"})
    with pytest.raises(PlanError):
        assemble([X], {**data, "customer": data["customer"].union(data["customer"])}, config, out, check_keys=True)
    with pytest.warns(UserWarning), pytest.raises(PlanError):
        assemble([X], {"customer": data["customer"]}, config, out)


def test_repeated_keys(spark):
    """A key that repeats fails the query that meets it; unchecked, rows are joined as they are and the last of a block counts in sequences."""
    data, config = tables(spark, {(1, FIRST): 2.0, (2, FIRST): 3.0}, [FIRST, FIRST + 1])
    live = data["customer"].withColumn("score", F.lit(5.0))
    data["customer"] = live.union(spark.createDataFrame([(1, FIRST, 7.0), (None, FIRST, 1.0), (None, FIRST, 2.0)], live.schema))
    out = {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}
    for feature in ("customer.score", "TIME_SINCE_SEEN(customer.score)", "ACCUMULATE(Customer.score)", "ACC(Customer.score)"):
        with pytest.raises(Exception, match="repeat"):
            assemble([feature], data, config, out, display=False).collect()
    # rows that no value asks for are not looked at
    assert assemble([X], data, config, out, display=False).count() == 4
    rows = assemble(["customer.score"], data, config, out, display=False, check_keys=False).collect()
    assert sorted((r["customer"], r["block"], r[0]) for r in rows) == [(1, FIRST, 5.0), (1, FIRST, 7.0), (1, FIRST + 1, 5.0), (2, FIRST, 5.0), (2, FIRST + 1, 5.0)]
    for feature, want in (("ACCUMULATE(Customer.score)", [7.0, 12.0, 5.0, 10.0]), ("LAST(Customer.score)", [7.0, 5.0, 5.0, 5.0]), ("ACC(Customer.score)", [7.0, 5.0, 5.0, 5.0])):
        rows = assemble([feature], data, config, out, display=False, check_keys=False).collect()
        assert [r[0] for r in sorted(rows, key=lambda r: (r["customer"], r["block"]))] == want, feature


def test_missing_blocks_are_told(spark):
    data, config = tables(spark, {(1, FIRST): 2.0}, [FIRST, FIRST + 2])
    out = {"customer": "customer.id", "block": ["1995-01-01", "1995-03-05"]}
    with pytest.warns(UserWarning, match="1 of 3 blocks"):
        assemble([X], data, config, out, check_blocks=True)


def test_rank_of_values_near_one_level(spark):
    values = {(k, FIRST): 1.7e9 + (k * 37 % 500) for k in range(500)}
    got = run(spark, [f"RANK({X})"], values, [FIRST])
    for (k, _), v in values.items():
        assert math.isclose(got[k, FIRST][0], (v - 1.7e9 + 1) / 500, abs_tol=1e-9)


def test_json_texts(spark):
    from blockframe.functions.nested import from_json_text

    texts = [
        '{"a": [1, 2, {"b": "x, y: z // no comment"}], "c": "d"}',
        "{a: [1, 2, {b: 'x, y: z // no comment',},], /* c: */ c: \"d\", // the end\n}",
        '{"a": []}',
        "no json",
        None,
        '{"a": [1, 2, {"b": "' + "long " * 20000 + '"}], c: 1,}',
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    at = lambda *path: [r[0] for r in df.select(from_json_text(F.col("t"), list(path))).collect()]
    assert at("a", 2, "b") == at("a", -1, "b") == ["x, y: z // no comment", "x, y: z // no comment", None, None, None, "long " * 20000]
    assert at("a", -3) == ["1", "1", None, None, None, "1"] and at("a", -4) == [None] * 6
    assert at("c") == ["d", "d", None, None, None, "1"]


def test_caller_keeps_tables_and_mock(spark):
    data, config = tables(spark, {(0, FIRST): 1.0}, [FIRST])
    before = dict(data)
    df = assemble([X, "customer.id"], data, config, {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}, mock=True)
    row = df.first()
    assert data == before and row[0] == row[1] == 54321 and row["block"] == row["__dcount__"] == "1995-01" and row["customer"] == 0


def test_ambiguous_pointers_need_a_map(spark):
    data, config = tables(spark, {(1, FIRST): 1.0}, [FIRST])
    data["customer"] = data["customer"].withColumn("friend", F.lit(1).cast("long"))
    config["pair"] = {"key": "id", "pointers": {"left": "customer.id", "right": "customer.id"}}
    data["pair"] = spark.createDataFrame([(1, 1, 1)], "id long, left long, right long")
    out = {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}
    assert assemble(["Pair.COUNT(id|left)"], data, config, out).first()[0] == 1
    with pytest.raises(PlanError):
        assemble(["Pair.COUNT(id|DATE(nothing))"], data, config, out)


def test_registry_is_complete():
    packs = {"default": 15, "counts": 3, "nested": 3, "compare": 5, "future": 2, "trend": 2, "people": 1, "formatter": 2, "window": 4, "datetime": 4, "round": 2, "math": 3}
    assert {k: sum(f.pack == k for f in REGISTRY.values()) for k in packs} == packs
    assert len(REGISTRY) == 46


def test_natural_breaks():
    import itertools

    import numpy as np

    values = np.array([1.0, 2.0, 4.0, 10.0, 11.0, 30.0])
    weights = np.array([1.0, 3.0, 1.0, 2.0, 1.0, 1.0])

    def cost(edges):
        total, i = 0.0, 0
        for j in edges:
            x, w = values[i:j], weights[i:j]
            total += (w * (x - (w * x).sum() / w.sum()) ** 2).sum()
            i = j
        return total

    best = min((c + (6,) for c in itertools.combinations(range(1, 6), 2)), key=cost)
    assert natural_breaks(values, weights, 3) == [float(values[j - 1]) for j in best]
    assert natural_breaks(values[:2], weights[:2], 5) == [1.0, 2.0] and natural_breaks(values[:0], weights[:0], 3) == []


def test_breaks_of_many_distinct_values_are_exact(spark):
    values = np.concatenate([np.arange(30000) / 30, 1e6 + np.arange(3)])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    deviation = lambda x: ((x - x.mean()) ** 2).sum()
    assert class_breaks(df, 2) == [values[29999], values[-1]]
    got = class_breaks(df, 3)
    assert got[1:] == [values[29999], values[-1]]
    at = int(np.searchsorted(values, got[0])) + 1
    own = [deviation(values[:x]) + deviation(values[x:30000]) for x in range(at - 3, at + 4)]
    assert min(own) == own[3]


def test_natural_breaks_against_every_cut():
    rng = np.random.default_rng(3)
    values, weights = np.unique(rng.lognormal(3, 2, 150)), rng.integers(1, 9, 150).astype(float)
    n = len(values)
    w, wx, wxx = (np.concatenate([[0.0], np.cumsum(x)]) for x in (weights, weights * values, weights * values**2))
    cost = lambda i, j: wxx[j] - wxx[i] - (wx[j] - wx[i]) ** 2 / (w[j] - w[i])
    best, back = [0.0] + [cost(0, j) for j in range(1, n + 1)], []
    for c in range(2, 6):
        at = {j: min(range(c - 1, j), key=lambda i: best[i] + cost(i, j)) for j in range(c, n + 1)}
        best = [best[at[j]] + cost(at[j], j) if j in at else np.inf for j in range(n + 1)]
        back.append(at)
        edges, j = [], n
        for cut in reversed(back):
            edges.append(float(values[j - 1]))
            j = cut[j]
        assert natural_breaks(values, weights, c) == [*reversed([*edges, float(values[j - 1])])]


def test_values_of_one_kind_share_their_plans(spark):
    features = [f"{f}({X})" for f in ("ACCUMULATE", "STREND", "FIRST", "LAST", "CP_CHANGED")] + [X, "Fact.COUNT(amount|customer,DATE(at))"]
    data, config = tables(spark, {(1, FIRST): 1.0}, [FIRST])
    df = assemble(features, data, config, {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 2  # one for the aggregates, one for the grid


def blown_up(spark, n=300, months=60):
    """A live table whose rows Spark takes for few: customers that are blown up by months."""
    live = spark.range(n).select("id", F.concat(F.lit("name "), "id").alias("name"), (F.col("id") % 5).alias("level"), F.explode(F.sequence(F.lit(FIRST), F.lit(FIRST + months - 1))).alias("block"))
    facts = spark.range(n).select("id", F.col("id").alias("customer"), F.lit("1995-03-15").alias("at"), F.col("id").cast("double").alias("amount"))
    config = {"customer": {"key": "id", "date_key": "block"}, "fact": {"key": "id", "pointers": {"customer": "customer.id"}, "order_by": ["id"]}}
    return {"customer": live, "fact": facts}, config, {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}


def test_values_of_the_live_table_need_no_join_to_itself(spark):
    data, config, out = blown_up(spark)
    df = assemble(["customer.name", "customer.level"], data, config, out, display=False)
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    rows = df.collect()
    assert len(rows) == 300 * 60 and all(r[0] == f"name {r['customer']}" and r[1] == r["customer"] % 5 for r in rows)


def test_blocks_are_grouped_by_entity(spark):
    """No aggregate has a key for each block of each entity."""
    data, config, out = blown_up(spark)
    df = assemble(["customer.name", X], data, config, out, display=False)
    assert df.count() == 300 * 60
    plan = assemble([X], data, config, out, display=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [id" in plan.replace("customer#", "id#") and "bit_or" in plan and "block#" not in next(x for x in plan.split("\n") if "bit_or" in x).split("]")[0]


def test_blown_up_rows_are_not_broadcast(spark):
    data, config, out = blown_up(spark)
    df = assemble(["TIME_SINCE(customer.level)", f"ACCUMULATE({X})"], data, config, out, display=False)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert df.count() == 300 * 60


def test_sequences_of_the_live_table_count_missing_blocks(spark):
    live = spark.createDataFrame([(1, FIRST, 1.0), (1, FIRST + 2, 2.0), (2, FIRST + 1, 4.0), (3, FIRST + 70, None)], "id long, block int, score double")
    config = {"customer": {"key": "id", "date_key": "block"}}
    out = {"customer": "customer.id", "block": ["1995-01-01", "2001-08-05"]}
    rows = assemble(["ACCUMULATE(customer.score)", "ACCUMULATE(customer.score,2)", "FUTURE_UNTIL(customer.score)"], {"customer": live}, config, out, display=False).collect()
    assert sorted((r["customer"], r["block"], *r[:3]) for r in rows) == [(1, FIRST, 1.0, 1.0, 0), (1, FIRST + 2, 3.0, 2.0, 0), (2, FIRST + 1, 4.0, 4.0, 0), (3, FIRST + 70, 0.0, 0.0, -999)]


def test_repeated_blocks_of_one_word(spark):
    data, config, out = blown_up(spark, 5)
    data["customer"] = data["customer"].union(data["customer"].where(f"id = 3 AND block = {FIRST + 7}"))
    with pytest.raises(Exception, match="keys of table customer repeat: 3"):
        assemble(["customer.name"], data, config, out, display=False).collect()
    assert assemble([X], data, config, out, display=False).count() == 5 * 60


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    from blockframe.functions.aggregates import exact_sum

    rng = random.Random(5)
    groups = [
        [0.1, 0.2, 0.3], [-0.1], [1e16, 1.0, -1e16], [0.1] * 10, [-0.1] * 7 + [0.7], [2.0**61] * 9, [5e-300, 1.0], [1e300, 1e300], [float("inf"), 1.0], [None], [],
        *([rng.uniform(-1, 1) * 10 ** rng.randint(-2, 12) for _ in range(rng.randint(1, 40))] for _ in range(200)),
    ]
    seen = []
    for turn in range(3):
        rows = [(i, v) for i, g in enumerate(groups) for v in rng.sample(g, len(g))]
        df = spark.createDataFrame(rows, "g int, v double").repartition(turn + 2)
        seen.append({r.g: r.s for r in df.groupBy("g").agg(exact_sum(F.col("v")).alias("s")).collect()})
    assert seen[0] == seen[1] == seen[2]
    for i, g in enumerate(groups):
        if g and g != [None] and i not in (7, 8):
            want = math.fsum(g)
            assert seen[0][i] == want or math.isclose(seen[0][i], want, rel_tol=2.0**-52), (g, seen[0][i])
        if len(g) == 1:
            assert seen[0][i] == g[0]
    assert seen[0][7] == math.inf or seen[0][7] == 2e300
    assert seen[0][8] == math.inf and seen[0][9] is None


def test_ranks_tie_where_sums_are_of_the_same_values(spark):
    """Added one after the other, three sums of the same values in different orders are 0.6 and 0.6000000000000001."""
    amounts = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [0.2, 0.3, 0.1], 4: [5.0]}
    rows = [(10 * k + i, k, "1995-01-15", a) for k, v in amounts.items() for i, a in enumerate(v)]
    data = {"customer": spark.createDataFrame([(k, FIRST) for k in amounts], "id long, block int"), "fact": spark.createDataFrame(rows, "id long, customer long, at string, amount double").coalesce(1)}
    config = {"customer": {"key": "id", "date_key": "block"}, "fact": {"key": "id", "pointers": {"customer": "customer.id"}}}
    got = assemble(["RANK(Fact.SUM(amount|customer,DATE(at)))"], data, config, {"customer": "customer.id", "block": ["1995-01-01", "1999-12-05"]}, display=False).collect()
    assert {r["customer"]: r[0] for r in got} == {1: 0.5, 2: 0.5, 3: 0.5, 4: 1.0}
