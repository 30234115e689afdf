"""Searches and shortest paths on a graph's arrays against plain ones, on files cut into small batches."""

import heapq
import itertools
import math
import random

import pytest

from lexiweave.functions import arrays
from lexiweave.graph import WordGraph
from lexiweave.operators import paths, reduction, reports, strategy


@pytest.fixture
def small_batches(spark, monkeypatch):
    monkeypatch.setattr(arrays, "ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def plain_search(graph, start, max_steps, max_paths):
    """The search with all successors of a state at once."""
    total = {s: sum(o.values()) for s, o in graph.items()}
    move = {s: {d: w / total[s] for d, w in sorted(o.items())} for s, o in graph.items()}
    entropy = {s: -sum(p * math.log2(p) for p in o.values()) for s, o in move.items()}
    one = {s: sum(p for d, p in o.items() if d[0] in "rst") for s, o in move.items()}
    agenda, met, ends = [(0.0, 0, (start,), 1.0, 0.0, 0.0)], set(), []
    while agenda and len(ends) < max_paths:
        _, steps, path, prob, e, gain = heapq.heappop(agenda)
        if (path[-1], steps) in met:
            continue
        met.add((path[-1], steps))
        if path[-1][0] in "rst":
            ends.append((path, steps, prob, e, gain))
        elif steps < max_steps:
            for d, p in move.get(path[-1], {}).items():
                if d not in path:
                    g, own = max(0.0, entropy[path[-1]] + math.log2(p)), e - p * math.log2(p)
                    heapq.heappush(agenda, (-round(0.4 * p + 0.3 * g + 0.2 / (1 + own) + 0.1 * one.get(d, 0.0), 11), steps + 1, (*path, d), prob * p, own, gain + g))
    return {path: pytest.approx((steps, prob, e, gain), abs=1e-9) for path, steps, prob, e, gain in ends}


def random_graph(rng, words, degree):
    return {w: {x: rng.random() * 9 + 0.1 for x in rng.sample([y for y in words if y != w], rng.randint(1, degree))} for w in words}


def test_search_of_a_graph_of_any_size(spark, monkeypatch, small_batches):
    """No bound on edges refuses a graph, and successors that come in parts keep the order of the search."""
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 3, raising=False)
    words = [a + b + c for a in "abcdefgrs" for b in "uvw" for c in "xyz"]
    graph = random_graph(random.Random(5), words, 70)
    got: dict = {w: {} for w in [*words, "elsewhere", "tail"]}
    for r in paths.best_first_paths(WordGraph.from_dict(spark, graph), list(got), 3, 4).collect():
        got[r.word][tuple(r.path)] = (r.steps, r.probability, r.entropy, r.gain)
    assert got.pop("elsewhere") == {} and list(got.pop("tail")) == [("tail",)]
    for w in words:
        assert got[w] == plain_search(graph, w, 3, 4)


def plain_dependencies(graph, start):
    """By Dijkstra's algorithm and a list of all shortest paths' edges."""
    dist, queue = {}, [(0.0, start)]
    while queue:
        d, u = heapq.heappop(queue)
        if u not in dist:
            dist[u] = d
            for v, w in graph.get(u, {}).items():
                heapq.heappush(queue, (d + w, v))
    order = sorted(dist, key=dist.get)
    tight = [(u, v) for u in order for v, w in graph.get(u, {}).items() if abs(dist[u] + w - dist[v]) <= 1e-12]
    count, depends = dict.fromkeys(order, 0.0) | {start: 1.0}, dict.fromkeys(order, 0.0)
    for u, v in tight:
        count[v] += count[u]
    for u, v in sorted(tight, key=lambda x: -dist[x[1]]):
        depends[u] += count[u] / count[v] * (1 + depends[v])
    return depends | {start: 0.0}


@pytest.mark.parametrize("weight", [lambda r: float(r.randint(1, 3)), lambda r: r.random() + 0.01])
def test_shortest_path_trees_on_arrays(spark, small_batches, weight):
    rng = random.Random(6)
    words = [f"w{i:02}" for i in range(40)]
    graph = {w: {x: weight(rng) for x in rng.sample(words, rng.randint(0, 8)) if x != w} for w in words}
    got = {r.word: r.betweenness for r in reduction.betweenness(WordGraph.from_dict(spark, graph), 1000).collect()}
    want = dict.fromkeys(got, 0.0)
    for w in got:
        for x, v in plain_dependencies(graph, w).items():
            want[x] += v / ((len(got) - 1) * (len(got) - 2))
    assert got == pytest.approx(want) and any(want.values())
    # a graph of 0.1 GB of documents has 2.4 million edges: it goes this way, not by joins of all pivots' trees
    assert reduction.BROADCAST_EDGES > 2_400_000


def test_edges_of_a_word_over_several_batches(spark, small_batches):
    g = WordGraph.from_dict(spark, {"b": {f"w{i}": i + 1.0 for i in range(8)}, "c": {"b": 2.0}})
    a = arrays.opened(arrays.graph_files(g))
    assert len(a.parts) > 1
    b, c = a.words.ids(["b", "c"])
    assert dict(zip(a.words.words.take(a.out(b)[0]).to_pylist(), a.out(b)[1])) == {f"w{i}": i + 1.0 for i in range(8)}
    import numpy as np

    found = [tuple(x) for s, d, w in a.edges_of(np.array([b, c], np.int32)) for x in zip(s, d, w)]
    assert len(found) == 9 and sum(w for *_, w in found) == 38
    assert list(itertools.chain(a.out(a.words.ids(["w1"])[0])[0])) == []


BEYOND = {"and": {"cat": 3, "dog": 2}, "cat": {"sun": 3, "egg": 1}, "dog": {"egg": 1, "tree": 2}, "egg": {"ram": 2, "and": 2}}


@pytest.fixture
def beyond(spark, monkeypatch):
    """A graph of more edges than the search once allowed."""
    monkeypatch.setattr(paths, "BROADCAST_EDGES", 3, raising=False)
    return WordGraph.from_dict(spark, BEYOND), spark.createDataFrame([("and",)], "word string")


def test_analysis_of_a_graph_of_any_size(beyond):
    assert strategy.analyze(*beyond, 3).first()["path_count"] == 3


def test_pathway_report_of_a_graph_of_any_size(beyond):
    assert [x["path"][-1] for x in reports.pathway_report(*beyond).first()["best"]].count("sun") == 1


def test_recommendations_on_a_graph_of_any_size(beyond):
    assert {r.next_word for r in strategy.multistep_recommend(*beyond, max_iterations=3).collect()} == {"cat", "dog"}


def test_strategic_depth_of_a_graph_of_any_size(beyond):
    assert reports.strategic_depth(*beyond, 3).first()["path_count"] == 3


def test_choice_on_a_graph_of_any_size(beyond):
    assert strategy.choose_moves(*beyond, "expert").count() == 1


def test_moves_on_a_graph_of_any_size(beyond):
    assert {r.move for r in strategy.evaluate_moves(*beyond).collect()} == {"cat", "dog"}


def test_chains_on_arrays(spark, small_batches):
    """The smallest next word on shortest ways of three words or more to each trap word."""
    rng = random.Random(8)
    words = [a + b for a in "abcdefrst" for b in "uvwxyz"]
    graph = {w: dict.fromkeys(rng.sample([x for x in words if x != w], rng.randint(0, 3)), 1.0) for w in words}
    want = set()
    for t in (w for w in words if w[0] in "rst"):
        depth, level = {t: 0}, 0
        while front := {s for s in graph if s not in depth and any(depth.get(d) == level for d in graph[s])}:
            level += 1
            depth |= dict.fromkeys(front, level)
        after = {w: min(d for d in graph[w] if depth.get(d) == n - 1) for w, n in depth.items() if n}
        second = {after[w] for w, n in depth.items() if n == 2}
        want |= {(w, x) for w, x in after.items() if depth[w] >= 2 or w in second}
    got = [tuple(r) for r in reduction.chain_edges(WordGraph.from_dict(spark, graph), 50).collect()]
    assert set(got) == want and len(got) == len(want) > 40
    # no join of all targets with all edges, of which a graph of 0.1 GB made 18.9 million rows and spilled
    plan = reduction.chain_edges(WordGraph.from_dict(spark, graph), 50)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "Join" not in plan


def test_full_importance_needs_no_joins_of_trees(beyond, monkeypatch):
    """Betweenness for the importance of a graph with as many edges as 0.1 GB of documents has comes from the arrays."""
    monkeypatch.setattr(reduction, "_dependencies", lambda *a: pytest.fail("trees by joins"))
    monkeypatch.setattr(reduction, "BROADCAST_EDGES", reduction.BROADCAST_EDGES - 2_369_732)
    graph = beyond[0]
    assert reduction.edge_importance(graph, reduction.plain_pagerank(graph, 2), reduction.betweenness(graph, 1000)).count() == 8
