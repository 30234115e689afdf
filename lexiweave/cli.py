"""Command line over an edge CSV: analyze, word, details, recommend, export, simulate, tournament."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .graph import WordGraph
from .operators import metrics, ranking, reports, simulation
from .sources.edges import read_edge_csv
from .sources.sinks import format_table, write_csv


def _rows(df) -> list[tuple]:
    return [tuple(round(v, 4) if isinstance(v, float) else v for v in r) for r in df.collect()]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lexiweave")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "word", "details", "recommend", "export", "simulate", "tournament"):
        p = sub.add_parser(name)
        p.add_argument("csv")
        p.add_argument("--iterations", type=int, default=100, help="PageRank rounds at most")
        if name in ("simulate", "tournament"):
            p.add_argument("--games", type=int, default=100 if name == "simulate" else 10)
            p.add_argument("--max-turns", type=int, default=20)
            p.add_argument("--seed", type=int, default=7)
        if name == "simulate":
            p.add_argument("--first", choices=simulation.STRATEGIES, default="smart")
            p.add_argument("--second", choices=simulation.STRATEGIES, default="smart")
            p.add_argument("--target", help="word that wins the game")
            p.add_argument("--difficulty", type=float, default=0.8, help="share of turns in which smart plays its best moves")
        if name in ("word", "details", "recommend"):
            p.add_argument("word")
        if name in ("analyze", "recommend"):
            p.add_argument("--top", type=int, default=20 if name == "analyze" else 10)
        if name == "export":
            p.add_argument("output")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("lexiweave").getOrCreate()
    graph, rank = WordGraph(read_edge_csv(spark, args.csv)), {"max_iterations": args.iterations}
    if args.command == "analyze":
        summary = metrics.graph_summary(graph)
        print(format_table(summary.columns, _rows(summary)))
        best = ranking.rank_words(graph, args.top, **rank)
        rows = _rows(best.join(ranking.word_analysis(graph, **rank).drop("composite", "top_neighbors"), "word").orderBy(F.col("composite").desc(), "word"))
        print(f"Top {len(rows)} words\n" + format_table(["word", "composite", "neighbors", "out_sum", "one_step", "hardness", "richness", "pagerank"], rows))
        return 0
    if args.command == "export":
        write_csv(ranking.export_scores(graph, **rank), args.output)
        print(f"Scores written to {args.output}")
        return 0
    if args.command == "simulate":
        done = simulation.simulate_games(graph, args.games, args.first, args.second, args.max_turns, args.seed, args.target and args.target.lower(), args.difficulty).orderBy("result")
        print(format_table(done.columns, _rows(done)))
        return 0
    if args.command == "tournament":
        done = simulation.tournament(graph, games=args.games, max_turns=args.max_turns, seed=args.seed).orderBy(F.col("wins").desc(), "player")
        print(format_table(done.columns, _rows(done)))
        return 0
    word = args.word.lower()
    if not graph.has_word(word):
        print(f"Word not found: {word}")
        return 1
    if args.command == "details":
        found = reports.word_details(graph, **rank).where(F.col("word") == word)
        print(format_table(["", word], [(c, ", ".join(v) if isinstance(v, list) else v) for c, v in zip(found.columns, _rows(found)[0])]))
    elif args.command == "word":
        found = ranking.word_analysis(graph, **rank).where(F.col("word") == word)
        print(format_table(found.columns, _rows(found)))
    else:
        found = ranking.recommend(graph, spark.createDataFrame([(word,)], "word string"), args.top, **rank)
        print(format_table(found.columns, _rows(found)) or "No safe next word")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
