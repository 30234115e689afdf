"""Seeded game simulation: a table of games, one join and one arg-max a turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from ..functions.words import chance, is_trap
from ..graph import WordGraph
from .paths import distances, ways_to
from .strategy import avoid_scores, multistep_recommend

STRATEGIES = ("random", "greedy", "smart", "avoid")


def move_scores(graph: WordGraph) -> DataFrame:
    """src, dst, weight, trap and avoid: the weight times the opponent's risk."""
    a = avoid_scores(graph).select("src", "dst", F.round("score", 9).alias("avoid"))
    return graph.edges.join(a, ["src", "dst"]).select("src", "dst", "weight", is_trap("dst", graph.letters).alias("trap"), "avoid")


def _near(graph: WordGraph, targets: DataFrame, steps: int = 3) -> DataFrame:
    """target, dst: the words from which a target is at most `steps` moves away."""
    back = WordGraph(graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"), graph.letters)
    return distances(back, targets.select(F.col("target").alias("word")).distinct(), steps).select(F.col("start").alias("target"), F.col("word").alias("dst"), F.lit(True).alias("near"))


def picked(options: DataFrame, mover: Column, turn: int, seed: int, difficulty: float) -> DataFrame:
    """The move of each game among options(game, dst, weight, trap, avoid[, target, near]).

    greedy takes the heaviest edge, avoid the best `avoid`, random any. smart scores the weight by .3 for traps, or with a target by 2 for
    words near it and .5 for traps; it draws from its three best in `difficulty` of all turns, else from all. Ties go by luck, then by word."""
    luck = chance(F.lit(seed), F.col("game"), F.lit(turn), F.col("dst"))
    smart = F.col("weight") * F.when(F.col("trap"), 0.3).otherwise(1.0)
    if "target" in options.columns:
        aimed = F.col("weight") * F.when(F.col("near"), 2.0).otherwise(1.0) * F.when(F.col("trap"), 0.5).otherwise(1.0)
        smart = F.when(F.col("target").isNull(), smart).otherwise(aimed)
    best = Window.partitionBy("game").orderBy(smart.desc(), "dst")
    rows = options.withColumn("luck", luck).withColumn("n", F.row_number().over(best))
    sharp = chance(F.lit(seed), F.col("game"), F.lit(turn)) < difficulty
    pool = F.when(sharp & (F.col("n") > 3), -1.0).otherwise(F.col("luck"))
    value = F.when(mover == "greedy", F.col("weight")).when(mover == "avoid", F.col("avoid")).when(mover == "smart", pool).otherwise(F.col("luck"))
    return rows.groupBy("game").agg(F.max(F.struct(value.alias("v"), F.col("luck").alias("l"), "dst")).alias("m")).select("game", F.col("m.dst").alias("next"))


def play(graph: WordGraph, games: DataFrame, max_turns: int = 20, seed: int = 7, difficulty: float = 0.8) -> DataFrame:
    """games(game, word, first, second[, target]) -> game, first, second, ending, mover, turns, last.

    Players move in turn from the current word to a neighbour, by their strategies. ending: `stuck` (mover, first or second, has no move),
    `target` (mover has reached the game's target) or `timeout` after max_turns moves, also if the last of them reaches the target."""
    scores = written(move_scores(graph), "game-moves")
    keep = ["game", "first", "second", *(["target"] if "target" in games.columns else [])]
    live = games.select("word", *keep)
    near = written(_near(graph, games.where("target is not null")), "game-near") if "target" in games.columns else None
    ended = None

    def end(rows: DataFrame, kind: str, mover: str, turns: int) -> None:
        nonlocal ended
        rows = rows.select("game", "first", "second", F.lit(kind).alias("ending"), F.lit(mover).alias("mover"), F.lit(turns).alias("turns"), F.col("word").alias("last"))
        ended = rows if ended is None else ended.unionByName(rows)

    for turn in range(1, max_turns + 1):
        side = "first" if turn % 2 else "second"
        options = live.join(scores, live["word"] == scores["src"])
        options = options.join(near, ["target", "dst"], "left") if near is not None else options
        move = picked(options, F.col(side), turn, seed, difficulty) if max_turns else None
        step = written(live.join(move, "game", "left"), f"game-{turn}")
        end(step.where("next is null"), "stuck", side, turn - 1)
        live = step.where("next is not null").select(F.col("next").alias("word"), *keep)
        if near is not None and turn < max_turns:
            hit = F.coalesce(F.col("word") == F.col("target"), F.lit(False))
            end(live.where(hit), "target", side, turn)
            live = live.where(~hit)
    end(live, "timeout", "", max_turns)
    return ended


def starts(words: DataFrame, n: int, seed: int) -> DataFrame:
    """n words of words(word), drawn by hash (a sample is the feature here)."""
    return words.select("word").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("word")).cast("binary")), "word").limit(n)


def _table(words: DataFrame, first: Column, second: Column) -> DataFrame:
    return words.select(F.concat_ws("|", "word", first, second).alias("game"), "word", first.alias("first"), second.alias("second"))


def simulate_games(graph: WordGraph, n: int = 50, first: str = "greedy", second: str = "smart", max_turns: int = 20, seed: int = 7, target: str | None = None, difficulty: float = 0.8) -> DataFrame:
    """result, games, percent, avg_turns, min_turns, max_turns of n games from words drawn among all; result: first or second (has reached the
    target), trapped (a player had no move) or timeout."""
    games = _table(starts(graph.words, n, seed), F.lit(first), F.lit(second))
    games = games.withColumn("target", F.lit(target)) if target else games
    done = written(play(graph, games, max_turns, seed, difficulty), "simulated")
    result = F.when(F.col("ending") == "stuck", "trapped").when(F.col("ending") == "target", F.col("mover")).otherwise("timeout")
    per = done.groupBy(result.alias("result")).agg(F.count("*").alias("games"), F.avg("turns").alias("avg_turns"), F.min("turns").alias("min_turns"), F.max("turns").alias("max_turns"))
    return per.withColumn("percent", 100.0 * F.col("games") / F.sum("games").over(Window.partitionBy()))


def tournament(graph: WordGraph, players=STRATEGIES, games: int = 10, max_turns: int = 20, seed: int = 7) -> DataFrame:
    """player, wins, played, percent over all ordered pairs of different players; who is stuck loses, a game without an end is a draw."""
    spark = graph.edges.sparkSession
    pairs = spark.createDataFrame([(a, b) for a in players for b in players if a != b], "first string, second string")
    table = _table(starts(graph.sources, games, seed).crossJoin(F.broadcast(pairs)), F.col("first"), F.col("second"))
    done = written(play(graph, table, max_turns, seed), "tournament")
    won = lambda other: (F.col("ending") == "stuck") & (F.col("mover") == other)
    sides = done.select(F.explode(F.array(F.struct(F.col("first").alias("player"), won("second").alias("won")), F.struct(F.col("second").alias("player"), won("first").alias("won")))).alias("x")).select("x.*")
    return sides.groupBy("player").agg(F.count_if("won").alias("wins"), F.count("*").alias("played")).withColumn("percent", 100.0 * F.col("wins") / F.col("played"))


def strategic_game(graph: WordGraph, start: str, max_turns: int = 15, target: str | None = None, strategy: str = "basic", **rank) -> DataFrame:
    """turn, word, won: always the top recommendation (basic: by score; multistep: by the combined score), until the target or a trap is
    reached (won), there is none, or the turns are over. Recommendations never lead into a trap, so a trap can only be the start."""
    from .ranking import recommend

    spark = graph.edges.sparkSession
    best = None if strategy == "multistep" else written(recommend(graph, graph.sources, 1, **rank).select("word", "next_word"), "best-next")
    won = is_trap("word", graph.letters) | F.coalesce(F.col("word") == F.lit(target), F.lit(False))
    at = path = spark.createDataFrame([(0, start)], "turn int, word string").withColumn("won", F.lit(False))
    for turn in range(1, max_turns + 1):
        here = at.where("not won").select("word")
        move = here.join(best, "word") if best is not None else multistep_recommend(graph, here, 10, **rank).where("rank = 1").select("word", "next_word")
        at = written(move.select(F.lit(turn).alias("turn"), F.col("next_word").alias("word")).withColumn("won", won), f"strategic-{turn}")
        if not at.limit(1).count():
            break
        path = path.unionByName(at)
    return path


def weighted_games(graph: WordGraph, games: DataFrame, max_turns: int = 15, seed: int = 7) -> DataFrame:
    """games(start, target) -> start, target, turns, path, result (reached, dead end or timeout), success (product of the shortest path's weights).

    Each turn draws a neighbour with a chance in proportion to weight * (.5 for traps) * (1 + 10 * product of the shortest path from there to the
    target, or .001 without one) * noise in (.7, 1.3); a path may have as many words as turns are left."""
    ways = written(ways_to(graph, games.select("target").distinct(), max_turns), "game-ways")
    moves = graph.edges.select("src", "dst", F.col("weight") * F.when(is_trap("dst", graph.letters), 0.5).otherwise(1.0))
    moves = written(moves.toDF("src", "dst", "base"), "game-moves")
    live = games.distinct().select("start", "target", F.col("start").alias("word"), F.array("start").alias("path"))
    ended = None
    for turn in range(max_turns + 1):
        over = F.when(F.col("word") == F.col("target"), "reached").when(F.lit(turn == max_turns), "timeout")
        options = live.where(over.isNull()).join(moves, F.col("word") == F.col("src"))
        on = [options["target"] == ways["target"], options["dst"] == ways["word"], ways["words"] <= max_turns - turn - 1]
        options = options.join(ways.where("product > 0"), on, "left").select("start", options["target"], "dst", "base", "product")
        key = [F.lit(seed), F.col("start"), F.col("target"), F.lit(turn), F.col("dst")]
        weight = F.col("base") * (1 + 10 * F.coalesce("product", F.lit(0.001))) * (0.7 + 0.6 * chance(*key, F.lit("noise")))
        drawn = options.groupBy("start", "target").agg(F.min(F.struct((-F.log(chance(*key, F.lit("draw"))) / weight).alias("k"), F.col("dst").alias("next"))).alias("m"))
        step = written(live.withColumn("over", over).join(drawn.select("start", "target", "m.next"), ["start", "target"], "left"), f"weighted-{turn}")
        done = step.where("over is not null or next is null").select("start", "target", F.lit(turn).alias("turns"), "path", F.coalesce("over", F.lit("dead end")).alias("result"))
        ended = done if ended is None else ended.unionByName(done)
        live = step.where("over is null and next is not null").select("start", "target", F.col("next").alias("word"), F.concat("path", F.array("next")).alias("path"))
    whole = ways.select("target", F.col("word").alias("start"), F.col("product").alias("success"))
    return ended.join(whole, ["start", "target"], "left").withColumn("success", F.coalesce("success", F.lit(0.0)))
