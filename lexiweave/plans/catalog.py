"""Registry of the word-graph queries. Each runs over the graph of all documents: adjacent word pairs that occur twice or more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.words import is_trap
from ..graph import WordGraph
from ..operators import merging, metrics, multistep, pagerank, paths, ranking, reduction, reports, simulation, strategy
from ..operators.merging import ARTICLES, CONJUNCTIONS, REMAINING_WORDS
from ..operators.metrics import FUNCTION_WORDS
from ..sources import edges as sources
from . import oracles

#: Fixed iteration count, so that the SQL counterpart does the same work.
ITERATIONS = {"max_iterations": 10, "tolerance": 0.0}
START = ("and", "of", "in")

_graphs: dict[tuple, WordGraph] = {}


def graph(spark: SparkSession, sf_dir: str, least: float = 2.0) -> WordGraph:
    """The graph of a folder's documents, the same object as long as the folder doesn't change."""
    edges = sources.kept_document_edges(spark, sf_dir, least)
    key = (spark.sparkContext.applicationId, edges.written_path)
    if key not in _graphs:
        _graphs[key] = WordGraph(edges)
    return _graphs[key]


def forget() -> None:
    """Drop what graphs remember of earlier queries (ranks), not their edges."""
    for g in _graphs.values():
        g._memo.clear()


def _r(df: DataFrame, digits: int = 9) -> DataFrame:
    """df with its doubles rounded, so that the order of additions doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _per_source(spark, d) -> DataFrame:
    return sources.document_edges(spark.read.parquet(f"{d}/documents.parquet"), 2.0, ("source",))


def _factor():
    return F.when(F.substring("source", -1, 1).isin("0", "5"), 2.0).when(F.substring("source", -1, 1).isin("1", "6"), 1.5).otherwise(1.0)


def _lines(spark, rows: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in rows], "value string")


CONCEPTNET_LINES = (
    '/a/1\t/r/RelatedTo\t/c/en/fire/n\t/c/en/red\t{"weight": 2.5}',
    '/a/2\t/r/RelatedTo\t/c/en/fire\t/c/en/red\t{"weight": 0.5}',
    '/a/3\t/r/IsA\t/c/en/cat\t/c/en/animal\t{"source": 1}',
    '/a/4\t/r/IsA\t/c/fr/chat\t/c/en/animal\t{"weight": 1.0}',
    '/a/5\t/r/dbpedia\t/c/en/cat\t/c/en/tail\t{"weight": 1.0}',
    '/a/6\t/r/IsA\t/c/en/hot_dog\t/c/en/food\t{"weight": 1.0}',
    "/a/7\t/r/IsA\t/c/en/short",
    '/a/8\t/r/UsedFor\t/c/en/sun\t/c/en/sun\t{"weight": 1.0}',
)
COLON_LINES = ("FIRE: red 30, hot 12", "cat dog 5", "SUN: sun 4, star 9, bad x", "", "a: b: c 1")
ASSOCIATION_LINES = ("# note", "Cat  dog 12", "cat tail x", "sun\tstar 3.5 more", "sun sun 4", "moon", "red-hot fire 2")
SWOW_ROWS = (("Cat", "dog", "", "0.25"), ("cat", "dog", "0.5", "0.1"), ("sun", "sun", "1", ""), ("sun", "star x", "1", ""), ("sun", "star", None, "bad"), ("moon", "night", None, "0.75"))


def _swow(spark, _):
    return sources.parse_swow(spark.createDataFrame(SWOW_ROWS, "cue string, response string, `strength.R123` string, `strength` string"))


#: Targets of the games and of the trap report.
TARGETS = ("the", "la", "der")


def _conceptnet_table(g: WordGraph) -> DataFrame:
    """Every edge of a graph as assertion lines: two with a fourth of the weight, or one without a weight; odd relations and languages among them."""
    rel = F.element_at(F.array(F.lit("/r/RelatedTo"), F.lit("/r/IsA"), F.lit("/r/dbpedia")), F.length("src") % 3 + 1)
    lang = F.when(F.length("dst") % 7 == 0, "fr").otherwise("en")
    meta = F.when(F.col("weight") > 2, F.concat(F.lit('{"weight": '), (F.col("weight") / 4).cast("string"), F.lit("}"))).otherwise(F.lit('{"source": 1}'))
    value = F.concat_ws("\t", F.lit("/a/1"), rel, F.concat(F.lit("/c/"), lang, F.lit("/"), F.col("src"), F.lit("/n")), F.concat(F.lit("/c/en/"), F.col("dst")), meta)
    return g.edges.select((F.length("src") * 1000 + F.length("dst")).cast("long").alias("line"), value.alias("value"), F.explode(F.when(F.col("weight") > 2, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _colon_table(g: WordGraph) -> DataFrame:
    """Edges of weight 2 as triples, the others in one line a source."""
    triples = g.edges.where("weight = 2").select(F.concat_ws(" ", "src", F.upper("dst"), F.col("weight").cast("string")).alias("value"))
    pairs = g.edges.where("weight <> 2").groupBy(F.upper("src").alias("cue")).agg(F.concat_ws(", ", F.collect_list(F.concat_ws(" ", "dst", F.col("weight").cast("string")))).alias("p"))
    return triples.unionByName(pairs.select(F.concat_ws(": ", "cue", "p").alias("value")))


def _association_table(g: WordGraph) -> DataFrame:
    mark = F.when(F.length("dst") % 5 == 0, F.lit("# ")).otherwise(F.lit(" "))
    return g.edges.select(F.concat(mark, F.upper("src"), F.lit("\t"), F.col("dst"), F.lit("  "), F.col("weight").cast("string"), F.lit(" x")).alias("value"))


def _swow_table(g: WordGraph) -> DataFrame:
    """line, value with a header; the strength of odd weights stands in the last column, with text that is no number before it."""
    even = F.col("weight") % 2 == 0
    row = F.concat_ws("\t", F.initcap("src"), "dst", F.lit("7"), F.when(even, (F.col("weight") / 8).cast("string")).otherwise(F.lit("n/a")), F.when(even, F.lit("9")).otherwise((F.col("weight") / 16).cast("string")))
    head = g.edges.sparkSession.createDataFrame([(1, '"cue"\tresponse\tR1\tstrength.R123\t"strength"')], "line long, value string")
    return head.unionByName(g.edges.select((F.length("src") + 1).cast("long").alias("line"), row.alias("value")))


def _named(s, d, self_loops: bool) -> DataFrame:
    """The documents' sources as three data sets."""
    n = F.substring("source", -1, 1)
    name = F.when(n.isin("0", "3", "6", "9"), "swow").when(n.isin("1", "4", "7"), "usf").otherwise("conceptnet")
    per = sources.document_edges(s.read.parquet(f"{d}/documents.parquet"), 2.0, ("source",), self_loops)
    return per.withColumn("name", name if self_loops else F.when(name == "conceptnet", "conceptnet_light").otherwise(name))


def _pairs(s, starts=START, targets=TARGETS) -> DataFrame:
    return s.createDataFrame([(a, b) for a in starts for b in targets], "start string, target string")


def _plain(g: WordGraph) -> dict:
    """Ranks of a fixed number of rounds and no betweenness, for the reduction that SQL can follow."""
    return {"ranks": pagerank.pagerank(g, trap_bias=1.0, **ITERATIONS), "between": g.words.select("word", F.lit(0.0).alias("betweenness"))}


def _words(spark, d, names=START) -> DataFrame:
    """The start words of the single-word operators."""
    return spark.createDataFrame([(w,) for w in names], "word string")


def _positions(s, d):
    """Every word as a first position, scored by a fixed network."""
    g = graph(s, d)
    rows = reports.playable_moves(g).select("word", F.array("word").alias("history"), "moves")
    f = reports.position_features(rows, g.letters)
    return _r(f.select("word", *[F.get("features", F.lit(i)).alias(f"f{i}") for i in range(6)], reports.network_score(F.col("features"), [((7 * k) % 13 - 6) / 20 for k in range(33)]).alias("score")))


def _entropy(s, d):
    return _r(multistep.entropies(graph(s, d)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    g = graph
    letters = ("a", "e", "i", "o", "u")
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # sources
        "edges_bigram": lambda s, d: g(s, d).edges,
        "edges_cooccurrence": lambda s, d: sources.cooccurrence_edges(s.read.parquet(f"{d}/documents.parquet"), 3, 3, 10),
        "edges_cooccurrence_full": lambda s, d: sources.cooccurrence_edges(s.read.parquet(f"{d}/documents.parquet"), 5, 2, 25),
        "edges_events": lambda s, d: sources.event_transitions(s.read.parquet(f"{d}/events.parquet")),
        "edges_top_per_source": lambda s, d: sources.top_per_source(g(s, d).edges, 25),
        "conceptnet_parse": lambda s, d: sources.parse_conceptnet(_lines(s, CONCEPTNET_LINES), sources.CONCEPTNET_WIDE),
        "conceptnet_light_parse": lambda s, d: sources.parse_conceptnet(_lines(s, CONCEPTNET_LINES), sources.CONCEPTNET_LIGHT, 15, 0.5, "max"),
        "colon_parse": lambda s, d: sources.parse_colon_lines(_lines(s, COLON_LINES)),
        "association_parse": lambda s, d: sources.parse_association_lines(_lines(s, ASSOCIATION_LINES)),
        "swow_parse": _swow,
        "conceptnet_scan": lambda s, d: sources.parse_conceptnet(_conceptnet_table(g(s, d)), sources.CONCEPTNET_WIDE),
        "conceptnet_light_scan": lambda s, d: sources.parse_conceptnet(_conceptnet_table(g(s, d)), sources.CONCEPTNET_LIGHT, 15, 0.5, "max", 500, 1000),
        "colon_scan": lambda s, d: sources.parse_colon_lines(_colon_table(g(s, d))),
        "association_scan": lambda s, d: sources.parse_association_lines(_association_table(g(s, d))),
        "swow_targeted_scan": lambda s, d: sources.parse_swow(sources.delimited(_swow_table(g(s, d)))),
        "swow_manual_scan": lambda s, d: sources.parse_swow_lines(_swow_table(g(s, d)), last_line=9),
        # words and metrics
        "all_words": lambda s, d: g(s, d).words,
        "trap_words": lambda s, d: g(s, d).words.where("is_trap").select("word"),
        "vowel_traps": lambda s, d: _r(metrics.word_metrics(WordGraph(g(s, d).edges, letters)).select("word", "one_step", "escape_hardness")),
        "out_sums": lambda s, d: metrics.word_metrics(g(s, d)).select("word", "out_sum", "n_neighbors"),
        "one_step": lambda s, d: _r(metrics.word_metrics(g(s, d)).select("word", "one_step")),
        "escape_hardness": lambda s, d: _r(metrics.word_metrics(g(s, d)).select("word", "escape_hardness")),
        "richness": lambda s, d: _r(metrics.word_metrics(g(s, d)).select("word", "richness")),
        "graph_summary": lambda s, d: _r(metrics.graph_summary(g(s, d))),
        "weight_stats": lambda s, d: _r(metrics.weight_stats(g(s, d).edges)),
        "strong_edges": lambda s, d: metrics.strong_edges(g(s, d)),
        "neighbors_top10": lambda s, d: metrics.top_neighbors(g(s, d), 10),
        "incoming_top3": lambda s, d: metrics.top_incoming(g(s, d), 3),
        "trap_target_incoming": lambda s, d: metrics.trap_incoming(g(s, d), 20),
        "neighbors_of": lambda s, d: g(s, d).neighbors("and"),
        "incoming_of": lambda s, d: g(s, d).incoming("and"),
        "bounds_check": lambda s, d: metrics.bounds_check(g(s, d)),
        "function_word_connections": lambda s, d: _r(metrics.list_connections(g(s, d), FUNCTION_WORDS)),
        "function_word_reach": lambda s, d: metrics.list_reach(g(s, d), FUNCTION_WORDS),
        "cluster_centers": lambda s, d: metrics.cluster_centers(g(s, d), FUNCTION_WORDS),
        "escape_routes": lambda s, d: _r(metrics.list_escapes(g(s, d), FUNCTION_WORDS)),
        # rank and recommendation
        "pagerank_10": lambda s, d: _r(pagerank.pagerank(g(s, d), **ITERATIONS)),
        "plain_pagerank_10": lambda s, d: _r(pagerank.pagerank(g(s, d), trap_bias=1.0, **ITERATIONS)),
        "pagerank_positions": lambda s, d: ranking.pagerank_positions(g(s, d), **ITERATIONS).select("word", "position"),
        "composite_score": lambda s, d: _r(ranking.scores(g(s, d), **ITERATIONS).select("word", "composite")),
        "rank_words": lambda s, d: _r(ranking.rank_words(g(s, d), 50, **ITERATIONS)),
        "rank_all_words": lambda s, d: _r(ranking.rank_words(g(s, d), None, **ITERATIONS)),
        "recommend_next_word": lambda s, d: _r(ranking.recommend(g(s, d), g(s, d).sources, 10, **ITERATIONS)),
        "word_analysis": lambda s, d: _r(ranking.word_analysis(g(s, d), **ITERATIONS).select("word", "n_neighbors", "out_sum", "one_step", "escape_hardness", "pagerank", "composite", F.array_join(F.transform("top_neighbors", lambda x: x["word"]), " ").alias("top_words"))),
        "export_scores": lambda s, d: ranking.export_scores(g(s, d), **ITERATIONS),
        "score_distribution": lambda s, d: _r(metrics.score_distribution(ranking.scores(g(s, d), **ITERATIONS))),
        # multi-step
        "hit_within_3": lambda s, d: _r(multistep.hit_within(g(s, d), 3)),
        "k_step_exact": lambda s, d: _r(multistep.first_hit(g(s, d), 4).select("word", "step", "exact")),
        "k_step_cumulative": lambda s, d: _r(multistep.first_hit(g(s, d), 4).select("word", "step", "cumulative")),
        "k_step_4": lambda s, d: _r(multistep.k_step(g(s, d), 4)),
        "entropy_per_word": _entropy,
        "info_gain": lambda s, d: _r(multistep.information_gain(g(s, d))),
        "information_flow": lambda s, d: _r(multistep.information_flow(g(s, d))),
        "hit_comparison": lambda s, d: _r(multistep.compare_hits(g(s, d), 3)),
        # paths
        "trap_pathways": lambda s, d: paths.trap_pathways(g(s, d), START, 2, 2.0).select("word", "letter", "target", F.array_join("path", " ").alias("path"), "length", "total_weight"),
        "pathways_top5": lambda s, d: paths.best_pathways(paths.trap_pathways(g(s, d), START, 2, 2.0)).select("word", "letter", "rank", F.array_join("path", " ").alias("path"), "total_weight"),
        "direct_targets": lambda s, d: _r(paths.direct_targets(g(s, d), g(s, d).sources)),
        "bfs_distance": lambda s, d: paths.distances(g(s, d), START, 3),
        "all_paths_scored": lambda s, d: _r(paths.path_measures(g(s, d), START, 2).select("word", F.array_join("path", " ").alias("path"), "steps", "probability", "entropy", "gain", "score")),
        "shortest_paths": lambda s, d: paths.shortest_paths(g(s, d), _pairs(s, targets=("the", "and", "la", "der"))).withColumn("path", F.array_join("path", " ")),
        "ways_to": lambda s, d: paths.ways_to(g(s, d), _words(s, d, TARGETS).withColumnRenamed("word", "target"), 8),
        "best_first_paths": lambda s, d: paths.best_first_paths(g(s, d), START, 4, 10),
        "analyze_multi_step": lambda s, d: strategy.analyze(g(s, d), _words(s, d), 3),
        # merging, pruning, reduction
        "merge_sum": lambda s, d: merging.merge_sum(_per_source(s, d)),
        "merge_max": lambda s, d: merging.merge_max(_per_source(s, d)),
        "merge_running_avg": lambda s, d: merging.merge_running_average(_per_source(s, d).withColumn("f", _factor() * F.col("weight")), F.col("f"), ["source"]),
        "merge_composition": lambda s, d: _r(merging.composition(_per_source(s, d))),
        "prune_edges": lambda s, d: merging.prune(g(s, d)),
        "prune_impact": lambda s, d: _r(merging.prune_impact(g(s, d))),
        "prune_comparison": lambda s, d: _r(merging.prune_comparison(g(s, d))),
        "high_value_edges": lambda s, d: reduction.high_value_edges(g(s, d)),
        "chain_edges": lambda s, d: reduction.chain_edges(g(s, d), 50),
        "betweenness_sampled": lambda s, d: reduction.betweenness(g(s, d), 1000),
        "edge_importance": lambda s, d: _r(reduction.edge_importance(g(s, d), pagerank.pagerank(g(s, d), trap_bias=1.0, **ITERATIONS), g(s, d).words.select("word", F.lit(0.0).alias("betweenness")))),
        "edge_importance_full": lambda s, d: _r(reduction.edge_importance(g(s, d), pagerank.pagerank(g(s, d), trap_bias=1.0, **ITERATIONS), reduction.betweenness(g(s, d), 1000))),
        "merge_complete": lambda s, d: merging.merge_complete(_named(s, d, True), ["source"]),
        "merge_targeted": lambda s, d: merging.merge_targeted(_named(s, d, False), ["usf", "conceptnet_light"], ["source"]),
        "reduce_sizes": lambda s, d: reduction.reduce_sizes(g(s, d), **_plain(g(s, d))),
        "reduce_edges": lambda s, d: reduction.reduce_edges(g(s, d), 0.3, 1000, 50),
        # reports
        "trap_effectiveness": lambda s, d: _r(reports.trap_effectiveness(g(s, d))),
        "degrees": lambda s, d: reports.degrees(g(s, d)),
        "average_degree": lambda s, d: _r(reports.average_degree(g(s, d))),
        "word_details": lambda s, d: _r(reports.word_details(g(s, d), **ITERATIONS).withColumns({c: F.array_join(c, " ") for c in ("top_out", "top_traps", "top_in")})),
        "strategic_depth": lambda s, d: reports.strategic_depth(g(s, d), _words(s, d), 3),
        "pathway_report": lambda s, d: reports.pathway_report(g(s, d), _words(s, d)),
        "playable_moves": lambda s, d: reports.playable_moves(g(s, d)).select("word", F.array_join("moves", " ").alias("moves")),
        "position_scores": _positions,
        "weighted_choice": lambda s, d: reports.weighted_choice(g(s, d), _words(s, d)),
        "trap_potential": lambda s, d: reports.trap_potential(g(s, d), _pairs(s), 3).withColumn("path", F.array_join("path", " ")),
        # strategy and simulation
        "self_safety": lambda s, d: _r(strategy.self_safety(g(s, d), 3)),
        "opponent_danger": lambda s, d: _r(strategy.opponent_danger(g(s, d), 3)),
        "escape_route_count": lambda s, d: strategy.escape_routes(g(s, d)),
        "greedy_move": lambda s, d: strategy.greedy_moves(g(s, d)),
        "avoid_move_score": lambda s, d: _r(strategy.avoid_scores(g(s, d))),
        "strategic_value": lambda s, d: strategy.evaluate_moves(g(s, d), _words(s, d), "medium"),
        "choose_move": lambda s, d: strategy.choose_moves(g(s, d), _words(s, d), "expert"),
        "recommend_multistep": lambda s, d: _r(strategy.multistep_recommend(g(s, d), _words(s, d), 10, **ITERATIONS)),
        "simulate_games": lambda s, d: _r(simulation.simulate_games(g(s, d), 100, "greedy", "smart", 20)),
        "simulate_target_games": lambda s, d: _r(simulation.simulate_games(g(s, d), 100, "smart", "random", 20, target="the")),
        "tournament": lambda s, d: _r(simulation.tournament(g(s, d), games=10, max_turns=20)),
        "strategic_game": lambda s, d: simulation.strategic_game(g(s, d), "and", 15, "le", **ITERATIONS),
        "weighted_games": lambda s, d: simulation.weighted_games(g(s, d), _pairs(s), 15).withColumn("path", F.array_join("path", " ")),
    }
    return q


def oracle_sql() -> dict[str, str]:
    return oracles.build(FUNCTION_WORDS, ARTICLES + CONJUNCTIONS, START, TARGETS, REMAINING_WORDS)


__all__ = ["graph", "is_trap", "oracle_sql", "queries"]
