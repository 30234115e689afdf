"""The tiny graphs with known values, and invariants."""

import pytest
from pyspark.sql import functions as F

from lexiweave.graph import WordGraph
from lexiweave.operators import merging, metrics, multistep, paths, ranking, reduction, simulation, strategy
from lexiweave.operators.pagerank import pagerank

SAMPLE = {"start": {"color": 1}, "color": {"red": 2, "blue": 1}, "red": {"stop": 1}, "blue": {"go": 1}}
SCORES = {"a": {"red": 1, "blue": 1}, "red": {"stop": 1}, "blue": {"go": 1}}
STAR = {"center": {"word1": 0.5, "word2": 0.3, "trap": 0.2}, "word1": {}, "word2": {}, "trap": {}}
CHAIN = {"word1": {"word2": 1}, "word2": {"trap": 1}, "trap": {}}
CYCLE = {"word1": {"word2": 1}, "word2": {"word1": 1}}


def as_map(df, *cols):
    return {r[0]: r[1] if len(r) == 2 else tuple(r)[1:] for r in df.select(*cols).collect()}


def test_scores_values(spark):
    g = WordGraph.from_dict(spark, SCORES)
    m = as_map(metrics.word_metrics(g), "word", "one_step", "escape_hardness")
    assert m["a"] == (0.5, 0.5)
    assert as_map(multistep.hit_within(g, 2), "word", "p")["a"] == 0.5
    assert {r[0] for r in g.words.select("word").collect()} == {"a", "red", "blue", "stop", "go"}
    assert not g.has_word("stop") and g.has_word("a")
    ranks = as_map(pagerank(g), "word", "pagerank")
    assert sum(ranks.values()) == pytest.approx(1, rel=1e-6)
    assert ranks["a"] == pytest.approx(0.120882, abs=1e-6) and ranks["stop"] == pytest.approx(0.276035, abs=1e-6)
    s = as_map(ranking.scores(g), "word", "composite")
    assert s["a"] == pytest.approx(0.380342, abs=1e-6) and s["red"] == pytest.approx(0.671943, abs=1e-6)
    found = ranking.recommend(g, spark.createDataFrame([("a",)], "word string")).collect()
    assert [r["next_word"] for r in found] == ["blue"]


def test_sample_and_star_scores(spark):
    s = as_map(ranking.scores(WordGraph.from_dict(spark, SAMPLE)), "word", "composite", "pagerank")
    assert s["color"] == (pytest.approx(0.455121, abs=1e-6), pytest.approx(0.161443, abs=1e-6))
    ranked = [r["word"] for r in ranking.rank_words(WordGraph.from_dict(spark, SAMPLE), 3, max_iterations=12).collect()]
    assert ranked == ["color", "blue"]
    star = as_map(ranking.scores(WordGraph.from_dict(spark, STAR)), "word", "composite", "pagerank", "one_step")
    assert star["center"] == (pytest.approx(0.258777, abs=1e-6), pytest.approx(0.206186, abs=1e-6), pytest.approx(0.2))
    assert star["word1"][1] == pytest.approx(0.285848, abs=1e-6)


def first_hits(spark, graph, k):
    return {(r["word"], r["step"]): (r["exact"], r["cumulative"]) for r in multistep.first_hit(WordGraph.from_dict(spark, graph), k).collect()}


def test_first_hits(spark):
    chain = first_hits(spark, CHAIN, 2)
    assert chain[("word1", 1)] == (0, 0) and chain[("word1", 2)] == (1, 1) and chain[("word2", 1)] == (1, 1) and chain[("trap", 1)] == (0, 0)
    assert all(v == (0, 0) for v in first_hits(spark, CYCLE, 3).values())
    star = first_hits(spark, STAR, 3)
    assert star[("center", 1)][0] == pytest.approx(0.2) and star[("center", 2)] == (0, pytest.approx(0.2))
    lone = multistep.first_hit(WordGraph.from_dict(spark, {"word": {}}), 2).collect()
    assert [r["cumulative"] for r in lone] == [0, 0]


def test_hits_agree_off_traps(spark):
    r = multistep.compare_hits(WordGraph.from_dict(spark, SAMPLE), 3).first()
    assert r["max_diff"] == pytest.approx(0, abs=1e-12)
    assert as_map(multistep.k_step(WordGraph.from_dict(spark, SAMPLE), 4), "word", "p")["red"] == 0


def test_paths(spark):
    g = WordGraph.from_dict(spark, CHAIN)
    best = paths.best_first_paths(g, ["word1", "trap"], 3, 5).collect()
    assert {(r["word"], tuple(r["path"]), r["steps"], r["probability"]) for r in best} == {("word1", ("word1", "word2", "trap"), 2, 1.0), ("trap", ("trap",), 0, 1.0)}
    declared = paths.path_measures(g, ["word1"], 3).collect()
    assert len(declared) == 1 and declared[0]["score"] == pytest.approx(best[0]["score"] if best[0]["word"] == "word1" else best[1]["score"])
    walks = paths.trap_pathways(WordGraph.from_dict(spark, SAMPLE), ["start"], 3).collect()
    assert {(tuple(r["path"]), r["total_weight"]) for r in walks} == {(("color", "red"), 3.0)}
    back = paths.trap_pathways(WordGraph.from_dict(spark, {"a": {"b": 1}, "b": {"a": 1, "t": 1}}), ["a"], 4).collect()
    assert {tuple(r["path"]) for r in back} == {("b", "t")}
    assert {(r["word"], r["depth"]) for r in paths.distances(WordGraph.from_dict(spark, SAMPLE), ["start"], 3).collect()} == {("start", 0), ("color", 1), ("red", 2), ("blue", 2), ("stop", 3), ("go", 3)}
    pairs = spark.createDataFrame([("start", "stop"), ("start", "start"), ("go", "start")], "start string, target string")
    got = {(r["start"], r["target"]): (r["path"], r["product"]) for r in paths.shortest_paths(WordGraph.from_dict(spark, SAMPLE), pairs).collect()}
    assert got[("start", "stop")] == (["start", "color", "red", "stop"], 2.0) and got[("start", "start")] == (["start"], 1.0) and got[("go", "start")] == (None, 0.0)


def test_information(spark):
    g = WordGraph.from_dict(spark, STAR)
    h = as_map(multistep.entropies(g), "word", "entropy")["center"]
    gain = as_map(multistep.information_gain(g), "dst", "gain")
    import math

    assert h == pytest.approx(-sum(p * math.log2(p) for p in (0.5, 0.3, 0.2)))
    assert gain["trap"] == pytest.approx(max(0, h + math.log2(0.2))) and gain["word1"] == pytest.approx(h - 1)


def test_trap_letters(spark):
    assert WordGraph.from_dict(spark, SCORES, []).letters == ("r", "s", "t")
    g = WordGraph.from_dict(spark, SCORES, ["B"])
    assert as_map(metrics.word_metrics(g), "word", "one_step")["a"] == 0.5


def test_merging(spark):
    rows = spark.createDataFrame([("a", "b", 3.0, 1), ("a", "b", 1.0, 2), ("a", "b", 5.0, 3), ("c", "c", 2.0, 1)], "src string, dst string, weight double, n int")
    assert as_map(merging.merge_running_average(rows, F.col("weight"), ["n"]), "src", "weight") == {"a": 3.5}
    assert as_map(merging.merge_running_average(rows, F.col("weight"), ["n"], True), "src", "weight") == {"a": 3.5, "c": 2.0}
    assert as_map(merging.merge_sum(rows), "src", "weight") == {"a": 9.0} and as_map(merging.merge_max(rows), "src", "weight") == {"a": 5.0}
    g = WordGraph.from_dict(spark, {"the": {"cat": 1}, "cat": {"the": 1, "and": 2, "dog": 1}})
    left = {(r["src"], r["dst"]) for r in merging.prune(g).collect()}
    assert left == {("cat", "and"), ("cat", "dog")}


def test_weight_stats_and_empty_graph(spark):
    rows = spark.createDataFrame([("a", str(i), float(w)) for i, w in enumerate([1, 2, 3, 10])], "src string, dst string, weight double")
    r = metrics.weight_stats(rows).first()
    assert (r["min_weight"], r["max_weight"], r["mean_weight"], r["median_weight"]) == (1, 10, 4, 3)
    empty = WordGraph(rows.limit(0))
    assert metrics.graph_summary(empty).first()["n_edges"] == 0 and pagerank(empty).count() == 0


def brute_betweenness(graph, start):
    from itertools import permutations

    words = sorted(set(graph) | {d for o in graph.values() for d in o})
    total = dict.fromkeys(words, 0.0)
    for end in words:
        best, found = None, []
        for n in range(len(words) - 1):
            for mid in permutations([w for w in words if w not in (start, end)], n):
                p = (start, *mid, end)
                if end != start and all(b in graph.get(a, {}) for a, b in zip(p, p[1:])):
                    d = sum(graph[a][b] for a, b in zip(p, p[1:]))
                    if best is None or d < best:
                        best, found = d, [p]
                    elif d == best:
                        found.append(p)
        for p in found:
            for w in p[1:-1]:
                total[w] += 1 / len(found)
    return total


def test_betweenness(spark):
    graph = {"a": {"b": 1, "c": 1}, "b": {"d": 1}, "c": {"d": 1}, "d": {"e": 2}, "e": {"a": 1}}
    got = as_map(reduction.betweenness(WordGraph.from_dict(spark, graph), 10), "word", "betweenness")
    want = dict.fromkeys("abcde", 0.0)
    for s in "abcde":
        for w, v in brute_betweenness(graph, s).items():
            want[w] += v / 12
    assert got == {w: pytest.approx(v) for w, v in want.items()}


def test_reduce_keeps_target_or_must_keep(spark):
    graph = {f"w{i}": {f"w{(i * k) % 23}": float(k) for k in range(2, 7) if (i * k) % 23 != i} | ({"tree": 3.0} if i % 4 == 0 else {}) for i in range(23)} | {"tree": {"sun": 2.0, "rain": 1.0, "w1": 1.0}, "sun": {"w2": 1.0}}
    g = WordGraph.from_dict(spark, graph)
    n = g.edges.count()
    cut = reduction.reduce_edges(g, 0.7, 8, 3)
    kept, must = cut.count(), cut.where("must_keep").count()
    assert kept == max(int(n * 0.7), must)


def test_strategy_and_games(spark):
    g = WordGraph.from_dict(spark, {"cat": {"dog": 3, "sun": 2, "egg": 1}, "dog": {"cat": 1, "tree": 1}, "egg": {"pan": 1}, "pan": {"egg": 1, "cat": 1}})
    word = spark.createDataFrame([("cat",)], "word string")
    moves = {r["move"]: r["value"] for r in strategy.evaluate_moves(g, word).collect()}
    assert set(moves) == {"dog", "egg"} and all(0 <= v <= 1 for v in moves.values())
    for level in strategy.DIFFICULTIES:
        assert strategy.choose_moves(g, word, level).count() == 1
    a = sorted(map(tuple, simulation.simulate_games(g, 4, "greedy", "random", 6).collect()))
    assert a == sorted(map(tuple, simulation.simulate_games(g, 4, "greedy", "random", 6).collect())) and sum(r[1] for r in a) == 4
    t = simulation.tournament(g, ("greedy", "avoid"), 3, 5).collect()
    assert {r["played"] for r in t} == {6}
    assert simulation.strategic_game(g, "cat", 3, max_iterations=3).count() >= 2
    assert strategy.analyze(g, word, 3).first()["path_count"] >= 1
    assert strategy.multistep_recommend(g, word, max_iterations=3).count() == 2


def test_reports(spark):
    from lexiweave.operators import reports

    g = WordGraph.from_dict(spark, SAMPLE)
    eff = {r["word"]: r["combined"] for r in reports.trap_effectiveness(g, 2).collect()}
    assert eff["color"] == pytest.approx(0.7 * 2 / 3 + 0.3 * 2 / 3) and eff["red"] == pytest.approx(1.0) and eff["go"] == 0
    assert as_map(reports.degrees(g), "word", "out_degree", "in_degree")["red"] == (1, 1)
    p = reports.position_features(spark.createDataFrame([("sun", ["sun", "cat"], ["rat", "dog"]), ("cat", [], [])], "word string, history array<string>, moves array<string>"), g.letters)
    f = {r["word"]: r["features"] for r in p.collect()}
    assert f["sun"] == [2, 0.5, 2, 3, 1, 0.5] and f["cat"] == [0, 1, 0, 3, 0, 0]
    s = p.select("word", reports.network_score(F.col("features"), [0.1] * 33).alias("s")).collect()
    import math

    hidden = 0.1 + 0.1 * sum(f["sun"])
    assert {r["word"]: r["s"] for r in s}["sun"] == pytest.approx(1 / (1 + math.exp(-(0.1 + 4 * 0.1 * hidden))))
    draw = reports.weighted_choice(WordGraph.from_dict(spark, {f"w{i}": {"a": 9.0, "b": 1.0} for i in range(400)}), spark.createDataFrame([("zzz",)], "word string"))
    share = draw.where("move = 'a'").count() / 400
    assert 0.82 < share < 0.97
    label = {r["target"]: r["label"] for r in reports.trap_potential(g, spark.createDataFrame([("start", "color"), ("start", "nowhere")], "start string, target string")).collect()}
    assert label == {"color": "easy", "nowhere": "perfect trap"}


def test_move_queries_run_over_all_pairs(spark, monkeypatch):
    """strategic_value and choose_move see pairs of low weight too, as the other queries do."""
    from lexiweave.plans import catalog

    asked = []
    tiny = WordGraph.from_dict(spark, {"and": {"low": 2, "other": 12}, "low": {"on": 2, "red": 5}, "other": {"on": 3}, "on": {"and": 2}, "red": {"on": 4}})
    monkeypatch.setattr(catalog, "graph", lambda s, d, least=2.0: asked.append(least) or tiny)
    moves = catalog.queries()["strategic_value"](spark, "")
    assert {(r.word, r.move) for r in moves.collect()} == {("and", "low"), ("and", "other")}
    assert catalog.queries()["choose_move"](spark, "").count() == 1 and set(asked) == {2.0}


def test_search_with_least_probability(spark):
    """The same paths as a search whose result is cut afterwards."""
    import random

    rng = random.Random(3)
    names = [a + b for a in "abrso" for b in "xyz"]
    g = WordGraph.from_dict(spark, {n: {m: float(rng.choice([1, 1, 20])) for m in rng.sample(names, 3)} for n in names})
    got = [tuple(r) for r in paths.best_first_paths(g, names, 3, 3, least=0.3).collect()]
    want = [tuple(r) for r in paths.best_first_paths(g, names, 3, 3).where("probability > 0.3").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and 0 < len(got)


def test_betweenness_by_joins(spark, monkeypatch):
    """A graph too large for a worker gives the same figures."""
    import random

    rng = random.Random(4)
    g = WordGraph.from_dict(spark, {f"w{i}": {f"w{j}": float(rng.randint(1, 2)) for j in rng.sample(range(9), 2)} for i in range(8)})
    want = as_map(reduction.betweenness(g, 6), "word", "betweenness")
    monkeypatch.setattr(reduction, "BROADCAST_EDGES", 3)
    monkeypatch.setattr(reduction, "PIVOTS_AT_ONCE", 4)
    assert as_map(reduction.betweenness(g, 6), "word", "betweenness") == pytest.approx(want) and sum(want.values()) > 0


def test_chains_of_any_length(spark):
    chain = ["a", "b", "c", "d", "e", "f", "g", "red"]
    g = WordGraph.from_dict(spark, {x: {y: 1.0} for x, y in zip(chain, chain[1:])})
    assert {tuple(r) for r in reduction.chain_edges(g).collect()} == set(zip(chain, chain[1:]))


def test_full_importance_and_cooccurrence(spark, monkeypatch, tmp_path):
    """The queries with production parameters: betweenness takes its part, and pairs five places apart that are seen twice count."""
    from lexiweave.plans import catalog

    g = WordGraph.from_dict(spark, {"a": {"b": 2}, "b": {"c": 2, "d": 3}, "c": {"a": 4}, "d": {"on": 2}})
    monkeypatch.setattr(catalog, "graph", lambda s, d, least=2.0: g)
    q = catalog.queries()
    plain = {(r.src, r.dst): r.importance for r in q["edge_importance"](spark, "").collect()}
    between = as_map(reduction.betweenness(g, 1000), "word", "betweenness")
    got = {(r.src, r.dst): r.importance for r in q["edge_importance_full"](spark, "").collect()}
    assert got == pytest.approx({(s, d): v + 0.75 * (between[s] + between[d]) for (s, d), v in plain.items()}, abs=1e-8) and got != plain
    spark.createDataFrame([("one two three four five six",)] * 2, "text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert ("one", "six", 2.0) in {tuple(r) for r in q["edges_cooccurrence_full"](spark, str(tmp_path)).select("src", "dst", "weight").collect()}


def test_rounding_by_binary_value(spark):
    """As Python rounds, on ties, near ties and values between."""
    import random

    from lexiweave.functions.words import half_even

    rng = random.Random(1)
    values = [0.0, 0.0078125, 2.5e-6, 1.0171875, 1.0453125, 0.5, 1e-9, 123456.7890125, *(rng.random() * 10 ** rng.randint(-6, 5) for _ in range(500)), *(rng.randint(0, 10**7) / 2e6 for _ in range(500)), *(0.3 * rng.randint(1, 99) / 2 ** rng.randint(1, 9) for _ in range(500))]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", half_even(paths.F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 6) for r in got)


def test_export_rounds_as_its_sql(spark, monkeypatch):
    """Values whose ninth digits end in 500, as one score in a thousand does, are written with the digits that SQL gives."""
    import random

    import duckdb
    import pyarrow as pa

    rng = random.Random(2)
    values = [0.0, 0.0000125, 1.0, 1 / 128, *(rng.randint(0, 10**6) / 10**6 + 5e-7 for _ in range(3000)), *(rng.random() for _ in range(500))]
    rows = spark.createDataFrame([(f"w{i}", v, v, v, v, 1) for i, v in enumerate(values)], "word string, composite double, one_step double, escape_hardness double, pagerank double, n_neighbors long")
    monkeypatch.setattr(ranking, "scores", lambda *a, **b: rows)
    got = {r.word: r.composite_score for r in ranking.export_scores(None).collect()}
    t = pa.table({"word": list(got), "x": [values[int(w[1:])] for w in got]})  # noqa: F841
    want = dict(duckdb.sql("SELECT word, printf('%.6f', round(round(x, 9), 6)) FROM t").fetchall())
    assert got == want and len(got) == len(values)
