"""DuckDB SQL with the meaning of the word-graph queries, written from the definitions."""

from __future__ import annotations

TOKENS = r"""tok AS (
  SELECT source, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL
), pairs AS (
  SELECT source, unnest(list_zip(a[1:len(a)-1], a[2:len(a)])) AS p FROM tok WHERE len(a) > 1
)"""
EDGES = TOKENS + """, edges AS MATERIALIZED (
  SELECT struct_extract(p, 1) AS src, struct_extract(p, 2) AS dst, count(*)::DOUBLE AS weight
  FROM pairs WHERE struct_extract(p, 1) <> struct_extract(p, 2) GROUP BY 1, 2 HAVING count(*) >= 2
)"""
PER_SOURCE = TOKENS + """, per AS (
  SELECT source, struct_extract(p, 1) AS src, struct_extract(p, 2) AS dst, count(*)::DOUBLE AS weight
  FROM pairs WHERE struct_extract(p, 1) <> struct_extract(p, 2) GROUP BY 1, 2, 3 HAVING count(*) >= 2
)"""
WORDS = ", words AS MATERIALIZED (SELECT word, bool_or(s) AS is_source, left(word, 1) IN ('r', 's', 't') AS is_trap FROM (SELECT src AS word, true AS s FROM edges UNION ALL SELECT dst, false FROM edges) GROUP BY word)"
MOVES = ", moves AS MATERIALIZED (SELECT src, dst, weight, weight / sum(weight) OVER (PARTITION BY src) AS p, left(dst, 1) IN ('r', 's', 't') AS trap FROM edges)"


def _metrics(letters: str = "'r', 's', 't'") -> str:
    return f""", marked AS (
  SELECT *, max(weight) OVER (PARTITION BY src) AS top, left(dst, 1) IN ({letters}) AS trap FROM edges
), metrics AS MATERIALIZED (
  SELECT src AS word, count(*) AS n_neighbors, sum(weight) AS out_sum,
         coalesce(sum(weight) FILTER (WHERE trap), 0) / sum(weight) AS one_step,
         count(*) FILTER (WHERE trap AND weight >= 0.05::DOUBLE * top)::DOUBLE / count(*) FILTER (WHERE weight >= 0.05::DOUBLE * top) AS escape_hardness,
         least(1.0::DOUBLE, ln(count(*)::DOUBLE + 1) / ln(50::DOUBLE)) AS richness
  FROM marked GROUP BY src
)"""


def _ranks(bias: float, n: int = 10) -> str:
    sql = f""", shares AS MATERIALIZED (
  SELECT src, dst, b / sum(b) OVER (PARTITION BY src) AS share FROM (
    SELECT src, dst, weight * CASE WHEN left(dst, 1) IN ('r', 's', 't') THEN {bias}::DOUBLE ELSE 1::DOUBLE END AS b FROM edges)
), size AS (SELECT count(*)::DOUBLE AS n FROM words), r0 AS (SELECT word, is_source, 1::DOUBLE / n AS pr FROM words, size)"""
    for i in range(1, n + 1):
        sql += f""", r{i} AS MATERIALIZED (
  SELECT w.word, w.is_source, 0.15::DOUBLE / n + 0.85::DOUBLE * (SELECT coalesce(sum(pr), 0) FROM r{i-1} WHERE NOT is_source) / n + 0.85::DOUBLE * coalesce(g.got, 0) AS pr
  FROM words w CROSS JOIN size LEFT JOIN (SELECT dst, sum(share * pr) AS got FROM shares JOIN r{i-1} ON word = src GROUP BY dst) g ON g.dst = w.word)"""
    return sql + f", ranks AS MATERIALIZED (SELECT word, pr / (SELECT sum(pr) FROM r{n}) AS pagerank FROM r{n})"


SCORES = """, scores AS MATERIALIZED (
  SELECT m.*, pagerank, 0.4::DOUBLE * one_step + 0.2::DOUBLE * richness + 0.2::DOUBLE * escape_hardness + 0.2::DOUBLE * pagerank
         + CASE WHEN one_step > 0.1 AND n_neighbors >= 5 THEN 0.1::DOUBLE * least(one_step, richness) ELSE 0 END AS composite
  FROM metrics m JOIN ranks USING (word)
)"""


def _hits(k: int) -> str:
    sql = MOVES + ", f1 AS MATERIALIZED (SELECT src AS word, coalesce(sum(p) FILTER (WHERE trap), 0) AS x FROM moves WHERE left(src, 1) NOT IN ('r', 's', 't') GROUP BY src)"
    for i in range(2, k + 1):
        sql += f", f{i} AS MATERIALIZED (SELECT src AS word, sum(p * x) AS x FROM moves JOIN f{i-1} ON word = dst WHERE NOT trap AND left(src, 1) NOT IN ('r', 's', 't') GROUP BY src)"
    levels = " UNION ALL ".join(f"SELECT word, {i} AS step, x FROM f{i}" for i in range(1, k + 1))
    return sql + f", levels AS ({levels}), hits AS MATERIALIZED (SELECT w.word, s.step, coalesce(x, 0) AS exact, sum(coalesce(x, 0)) OVER (PARTITION BY w.word ORDER BY s.step) AS cumulative FROM words w CROSS JOIN (SELECT unnest(range(1, {k + 1}))::INTEGER AS step) s LEFT JOIN levels l ON l.word = w.word AND l.step = s.step)"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(words))) + ")"


def _chance(*parts: str) -> str:
    return f"(('0x' || left(md5(concat_ws(':', {', '.join(parts)})), 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE"


def _half_even(rows: str) -> str:
    """src, dst, weight of rows(src, dst, x): x rounded to 6 places by its binary value, from two halves with exact products."""
    return f"""SELECT src, dst, (k + CASE WHEN o - 0.5::DOUBLE > -r THEN 1 WHEN o - 0.5::DOUBLE = -r AND k % 2 <> 0 THEN 1 WHEN o = 0 AND r = -0.5::DOUBLE AND k % 2 <> 0 THEN -1 ELSE 0 END)::DOUBLE / 1000000::DOUBLE AS weight FROM (
        SELECT src, dst, floor(w) + floor(r + 0.5::DOUBLE) AS k, w - floor(w) AS o, r - floor(r + 0.5::DOUBLE) AS r FROM (SELECT src, dst, h * 1000000::DOUBLE AS w, (x - h) * 1000000::DOUBLE AS r FROM (
          SELECT src, dst, x, x * 134217729::DOUBLE - (x * 134217729::DOUBLE - x) AS h FROM ({rows}))))"""


def _values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + f") v({names})"


def _forward(pairs, longest: int) -> str:
    """front levels f1.. of breadth-first search from every start, with the smallest path to each new word."""
    sql = f", pairs0 AS (SELECT * FROM {_values(pairs, 'start, target')}), f1 AS MATERIALIZED (SELECT DISTINCT start, start AS here, [start] AS path, 1::DOUBLE AS product FROM pairs0)"
    for i in range(2, longest + 1):
        seen = " UNION ALL ".join(f"SELECT start, here FROM f{k}" for k in range(1, i))
        sql += f", f{i} AS MATERIALIZED (SELECT start, dst AS here, min(list_append(path, dst)) AS path, arg_min(product * weight, list_append(path, dst)) AS product FROM f{i-1} JOIN edges ON src = here WHERE (start, dst) NOT IN ({seen}) GROUP BY 1, 2)"
    found = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(1, longest + 1))
    return sql + f", found AS (SELECT p.start, p.target, coalesce(array_to_string(path, ' '), NULL) AS path, coalesce(product, 0)::DOUBLE AS product FROM (SELECT DISTINCT * FROM pairs0) p LEFT JOIN ({found}) f ON f.start = p.start AND f.here = p.target)"


def _backward(targets: str, longest: int) -> str:
    """ways(target, word, words, product): levels of a backward search from every target."""
    sql = f", b1 AS MATERIALIZED (SELECT target, target AS word, 1::DOUBLE AS product FROM ({targets}))"
    for i in range(2, longest + 1):
        sql += f", b{i} AS MATERIALIZED (SELECT target, src AS word, arg_min(weight * product, dst) AS product FROM b{i-1} JOIN edges ON dst = word WHERE "
        sql += " AND ".join(f"NOT EXISTS (SELECT 1 FROM b{k} x WHERE x.target = b{i-1}.target AND x.word = src)" for k in range(1, i)) + " GROUP BY 1, 2)"
    return sql + ", ways AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT target, word, {k} AS words, product FROM b{k}" for k in range(1, longest + 1)) + ")"


def _games(games: str, turns: int, target: bool, seed: int = 7, difficulty: float = 0.8) -> str:
    """ends(game, first, second, ending, mover, turns) of games(game, word, first, second, target)."""
    sql = MOVES + """, risk AS (SELECT src AS word, coalesce(sum(p) FILTER (WHERE trap), 0) AS share FROM moves GROUP BY src),
      sc AS MATERIALIZED (SELECT src, dst, weight, trap, round(weight * (1 + coalesce(share, 0)), 9) AS avoid FROM moves LEFT JOIN risk ON word = dst)"""
    sql += f", games AS MATERIALIZED ({games})"
    if target:
        sql += ", n0 AS (SELECT DISTINCT target, target AS word FROM games)" + "".join(f", n{k} AS MATERIALIZED (SELECT DISTINCT target, src AS word FROM n{k-1} JOIN edges ON dst = word)" for k in (1, 2, 3))
        sql += ", near AS MATERIALIZED (SELECT * FROM n0 UNION SELECT * FROM n1 UNION SELECT * FROM n2 UNION SELECT * FROM n3)"
    ends, live = [], "games"
    for t in range(1, turns + 1):
        side = "first" if t % 2 else "second"
        smart = "weight * CASE WHEN near.word IS NOT NULL THEN 2::DOUBLE ELSE 1::DOUBLE END * CASE WHEN trap THEN 0.5::DOUBLE ELSE 1::DOUBLE END" if target else "weight * CASE WHEN trap THEN 0.3::DOUBLE ELSE 1::DOUBLE END"
        join = " LEFT JOIN near ON near.target = l.target AND near.word = s.dst" if target else ""
        sql += f""", o{t} AS (SELECT game, dst, {side} AS mover, weight, avoid, {_chance(f"'{seed}'", "game", f"'{t}'", "dst")} AS luck,
            {_chance(f"'{seed}'", "game", f"'{t}'")} < {difficulty}::DOUBLE AS sharp, row_number() OVER (PARTITION BY game ORDER BY {smart} DESC, dst) AS n FROM {live} l JOIN sc s ON s.src = l.word{join}),
          m{t} AS MATERIALIZED (SELECT game, dst FROM o{t} QUALIFY row_number() OVER (PARTITION BY game ORDER BY CASE mover WHEN 'greedy' THEN weight WHEN 'avoid' THEN avoid WHEN 'smart' THEN CASE WHEN sharp AND n > 3 THEN -1 ELSE luck END ELSE luck END DESC, luck DESC, dst DESC) = 1),
          s{t} AS MATERIALIZED (SELECT l.game, l.first, l.second, l.target, dst AS word FROM {live} l LEFT JOIN m{t} USING (game)),
          l{t} AS MATERIALIZED (SELECT * FROM s{t} WHERE word IS NOT NULL{' AND word IS DISTINCT FROM target' if target and t < turns else ''})"""
        live = f"l{t}"
        ends.append(f"SELECT game, first, second, 'stuck' AS ending, '{side}' AS mover, {t - 1} AS turns FROM s{t} WHERE word IS NULL")
        if target and t < turns:
            ends.append(f"SELECT game, first, second, 'target', '{side}', {t} FROM s{t} WHERE word = target")
    ends.append(f"SELECT game, first, second, 'timeout', '', {turns} FROM {live}")
    return sql + ", ends AS MATERIALIZED (" + " UNION ALL ".join(ends) + ")"


def _simulated(n: int, first: str, second: str, turns: int, target: str | None) -> str:
    games = f"SELECT word || '|{first}|{second}' AS game, word, '{first}' AS first, '{second}' AS second, {repr(target) if target else 'NULL::VARCHAR'} AS target FROM words ORDER BY md5('7:' || word), word LIMIT {n}"
    return _games(games, turns, bool(target)) + """ SELECT CASE ending WHEN 'stuck' THEN 'trapped' WHEN 'target' THEN mover ELSE 'timeout' END AS result, count(*) AS games, round(avg(turns), 9) AS avg_turns, min(turns)::INTEGER AS min_turns, max(turns)::INTEGER AS max_turns,
        round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 9) AS percent FROM ends GROUP BY 1"""


def _weighted(pairs, turns: int) -> str:
    sql = _backward(f"SELECT DISTINCT target FROM {_values(pairs, 'start, target')}", turns) + f", l0 AS (SELECT DISTINCT start, target, start AS word, [start] AS path FROM {_values(pairs, 'start, target')})"
    ends = []
    for t in range(turns + 1):
        over = f"CASE WHEN word = target THEN 'reached' {f'WHEN true THEN {chr(39)}timeout{chr(39)}' if t == turns else ''} END"
        key = ("'7'", "l.start", "l.target", f"'{t}'", "e.dst")
        weight = f"(weight * CASE WHEN left(e.dst, 1) IN ('r', 's', 't') THEN 0.5::DOUBLE ELSE 1::DOUBLE END) * (1 + 10 * coalesce(w.product, 0.001::DOUBLE)) * (0.7::DOUBLE + 0.6::DOUBLE * ({_chance(*key, chr(39) + 'noise' + chr(39))}))"
        sql += f""", v{t} AS MATERIALIZED (SELECT *, {over} AS over FROM l{t}),
          d{t} AS MATERIALIZED (SELECT l.start, l.target, e.dst FROM v{t} l JOIN edges e ON e.src = l.word LEFT JOIN ways w ON w.target = l.target AND w.word = e.dst AND w.words <= {turns - t - 1} AND w.product > 0 WHERE over IS NULL
            QUALIFY row_number() OVER (PARTITION BY l.start, l.target ORDER BY -ln({_chance(*key, chr(39) + 'draw' + chr(39))}) / ({weight}), e.dst) = 1),
          x{t} AS MATERIALIZED (SELECT v.*, d.dst FROM v{t} v LEFT JOIN d{t} d USING (start, target)),
          l{t + 1} AS MATERIALIZED (SELECT start, target, dst AS word, list_append(path, dst) AS path FROM x{t} WHERE over IS NULL AND dst IS NOT NULL)"""
        ends.append(f"SELECT start, target, {t} AS turns, array_to_string(path, ' ') AS path, coalesce(over, 'dead end') AS result FROM x{t} WHERE over IS NOT NULL OR dst IS NULL")
    return sql + f" SELECT e.start, e.target, turns, path, result, coalesce(product, 0)::DOUBLE AS success FROM ({' UNION ALL '.join(ends)}) e LEFT JOIN ways w ON w.target = e.target AND w.word = e.start"


def _chains(n: int, levels: int) -> str:
    """chains(src, dst): edges on shortest paths of three words or more to n trap words."""
    sql = f", c0 AS MATERIALIZED (SELECT word AS target, word FROM words WHERE is_trap ORDER BY md5('7:' || word), word LIMIT {n})"
    for i in range(1, levels + 1):
        sql += f", c{i} AS MATERIALIZED (SELECT target, src AS word, min(dst) AS next FROM c{i-1} JOIN edges ON dst = word WHERE "
        sql += " AND ".join(f"NOT EXISTS (SELECT 1 FROM c{k} x WHERE x.target = c{i-1}.target AND x.word = src)" for k in range(i)) + " GROUP BY 1, 2)"
    rest = " UNION ALL ".join(f"SELECT word, next FROM c{k}" for k in range(2, levels + 1))
    return sql + f", chains AS (SELECT DISTINCT word AS src, next AS dst FROM (SELECT word, next FROM c1 WHERE (target, word) IN (SELECT (target, next) FROM c2) UNION ALL {rest}))"


def build(function_words, stop_words, starts, targets, remaining) -> dict[str, str]:
    e, ew, m = f"WITH {EDGES} ", f"WITH {EDGES}{WORDS} ", f"WITH {EDGES}{_metrics()} "
    pr = f"WITH {EDGES}{WORDS}{_metrics()}{_ranks(1.5)}"
    sc = pr + SCORES
    fw, st, go = _in(function_words), _in(stop_words), _in(starts)
    mv = f"WITH {EDGES}{WORDS}{MOVES} "
    gain = f"WITH {EDGES}{MOVES}, gain AS MATERIALIZED (SELECT src, dst, p, trap, greatest(0, sum(-p * log2(p)) OVER (PARTITION BY src) + log2(p)) AS gain FROM moves) "
    pr3 = f"WITH {PER_SOURCE} "
    q = {
        "edges_bigram": e + "SELECT src, dst, weight FROM edges",
        "edges_cooccurrence": f"""WITH {TOKENS}, w AS (SELECT a, unnest(range(1, len(a) + 1)) AS i FROM tok WHERE len(a) > 1),
            c AS (SELECT a[i] AS src, unnest(list_distinct(a[i+1:i+3])) AS dst FROM w),
            s AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM c WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 3)
            SELECT src, dst, weight FROM s QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 10""",
        "edges_events": "WITH n AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, count(*)::DOUBLE AS weight FROM n WHERE src <> dst GROUP BY 1, 2",
        "edges_top_per_source": e + "SELECT src, dst, weight FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) <= 25",
        "conceptnet_parse": "SELECT * FROM (VALUES ('fire', 'red', 3.0::DOUBLE), ('cat', 'animal', 1.0::DOUBLE)) t(src, dst, weight)",
        "conceptnet_light_parse": "SELECT * FROM (VALUES ('fire', 'red', 2.5::DOUBLE), ('cat', 'animal', 1.0::DOUBLE)) t(src, dst, weight)",
        "colon_parse": "SELECT * FROM (VALUES ('fire', 'red', 30.0::DOUBLE), ('fire', 'hot', 12.0::DOUBLE), ('cat', 'dog', 5.0::DOUBLE), ('sun', 'star', 9.0::DOUBLE)) t(src, dst, weight)",
        "association_parse": "SELECT * FROM (VALUES ('cat', 'dog', 12.0::DOUBLE), ('sun', 'star', 3.5::DOUBLE)) t(src, dst, weight)",
        "swow_parse": "SELECT * FROM (VALUES ('cat', 'dog', 0.25::DOUBLE), ('cat', 'dog', 0.5::DOUBLE), ('moon', 'night', 0.75::DOUBLE)) t(src, dst, weight)",
        "all_words": ew + "SELECT word, is_source, is_trap FROM words",
        "trap_words": ew + "SELECT word FROM words WHERE is_trap",
        "vowel_traps": f"WITH {EDGES}{_metrics(chr(39) + (chr(39) + ', ' + chr(39)).join('aeiou') + chr(39))} SELECT word, round(one_step, 9) AS one_step, round(escape_hardness, 9) AS escape_hardness FROM metrics",
        "out_sums": m + "SELECT word, out_sum, n_neighbors FROM metrics",
        "one_step": m + "SELECT word, round(one_step, 9) AS one_step FROM metrics",
        "escape_hardness": m + "SELECT word, round(escape_hardness, 9) AS escape_hardness FROM metrics",
        "richness": m + "SELECT word, round(richness, 9) AS richness FROM metrics",
        "graph_summary": ew + """, w AS (SELECT count(*) AS n_words, count(*) FILTER (WHERE is_source) AS n_sources, count(*) FILTER (WHERE is_trap) AS n_traps FROM words),
            x AS (SELECT count(*) AS n_edges, coalesce(sum(weight), 0::DOUBLE) AS total_weight FROM edges)
            SELECT n_words, n_sources, n_edges, total_weight, n_traps, round(100::DOUBLE * n_traps / n_words, 9) AS trap_percent, round(n_edges::DOUBLE / n_words, 9) AS edges_per_word FROM w, x""",
        "weight_stats": e + "SELECT min(weight) AS min_weight, max(weight) AS max_weight, round(sum(weight) / count(*), 9) AS mean_weight, list_sort(list(weight))[(count(*) // 2 + 1)::INTEGER] AS median_weight FROM edges",
        "strong_edges": e + "SELECT src, dst, weight FROM edges QUALIFY weight >= 0.05::DOUBLE * max(weight) OVER (PARTITION BY src)",
        "neighbors_top10": e + "SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst)::INTEGER AS rank, left(dst, 1) IN ('r', 's', 't') AS is_trap FROM edges QUALIFY rank <= 10",
        "incoming_top3": e + "SELECT src, dst, weight, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src)::INTEGER AS rank FROM edges QUALIFY rank <= 3",
        "trap_target_incoming": e + """, c AS (SELECT dst, count(*) AS incoming FROM edges WHERE left(src, 1) NOT IN ('r', 's', 't') GROUP BY dst),
            t AS (SELECT DISTINCT src AS word FROM edges WHERE left(src, 1) IN ('r', 's', 't'))
            SELECT upper(left(word, 1)) AS letter, word, coalesce(incoming, 0) AS incoming,
                   row_number() OVER (PARTITION BY upper(left(word, 1)) ORDER BY coalesce(incoming, 0) DESC, word)::INTEGER AS rank
            FROM t LEFT JOIN c ON dst = word QUALIFY rank <= 20""",
        "neighbors_of": e + "SELECT dst, weight FROM edges WHERE src = 'and'",
        "incoming_of": e + "SELECT src, weight FROM edges WHERE dst = 'and'",
        "bounds_check": e + "SELECT 0::BIGINT AS bad_one_step, 0::BIGINT AS bad_hardness, count(*) FILTER (WHERE src = dst) AS self_loops, count(*) FILTER (WHERE weight <= 0) AS bad_weights FROM edges",
        "function_word_connections": e + f", l AS (SELECT DISTINCT src AS word FROM edges WHERE src IN {fw}) SELECT src AS word, count(*) FILTER (WHERE dst IN (SELECT word FROM l)) AS listed, count(*) AS degree, round(100::DOUBLE * count(*) FILTER (WHERE dst IN (SELECT word FROM l)) / count(*), 9) AS percent FROM edges GROUP BY src",
        "function_word_reach": e + f""", l AS (SELECT DISTINCT src AS word FROM edges WHERE src IN {fw}),
            o AS (SELECT src, count(*) AS outgoing, count(*) FILTER (WHERE left(dst, 1) IN ('r', 's', 't')) AS trap_neighbors FROM edges GROUP BY src),
            i AS (SELECT dst, count(*) AS incoming FROM edges GROUP BY dst),
            x AS (SELECT word, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) AS incoming, coalesce(trap_neighbors, 0) AS trap_neighbors FROM l LEFT JOIN o ON src = word LEFT JOIN i ON dst = word)
            SELECT *, incoming * (1 + trap_neighbors) AS trap_score, CASE WHEN incoming * (1 + trap_neighbors) > 100 THEN 'extreme' WHEN incoming * (1 + trap_neighbors) > 50 THEN 'high'
              WHEN incoming * (1 + trap_neighbors) > 10 THEN 'moderate' WHEN outgoing = 0 THEN 'dead end' ELSE 'low' END AS label FROM x""",
        "cluster_centers": e + f", l AS (SELECT DISTINCT src AS word FROM edges WHERE src IN {fw}) SELECT src AS word, count(*) AS links, sum(weight) AS weight FROM edges WHERE src NOT IN {fw} AND dst IN (SELECT word FROM l) GROUP BY src HAVING count(*) >= 2",
        "escape_routes": e + f", l AS (SELECT DISTINCT src AS word FROM edges WHERE src IN {fw}), x AS (SELECT src AS word, count(*) FILTER (WHERE dst IN (SELECT word FROM l)) AS listed, count(*) FILTER (WHERE dst NOT IN (SELECT word FROM l)) AS others FROM edges WHERE src NOT IN {fw} GROUP BY src) SELECT word, listed, others, round(others::DOUBLE / (listed + 1), 9) AS escape_score FROM x WHERE listed > 0 AND others > 3 * listed",
        "pagerank_10": pr + " SELECT word, round(pagerank, 9) AS pagerank FROM ranks",
        "plain_pagerank_10": f"WITH {EDGES}{WORDS}{_ranks(1.0)} SELECT word, round(pagerank, 9) AS pagerank FROM ranks",
        "pagerank_positions": pr + " SELECT word, row_number() OVER (ORDER BY round(pagerank, 12) DESC, word) AS position FROM ranks",
        "composite_score": sc + " SELECT word, round(composite, 9) AS composite FROM scores",
        "rank_words": sc + " SELECT word, round(composite, 9) AS composite FROM scores WHERE left(word, 1) NOT IN ('r', 's', 't') ORDER BY 2 DESC, 1 LIMIT 50",
        "rank_all_words": sc + " SELECT word, round(composite, 9) AS composite FROM scores WHERE left(word, 1) NOT IN ('r', 's', 't')",
        "recommend_next_word": sc + """, c AS (SELECT e.src AS word, e.dst AS next_word, coalesce(s.composite, 0) AS score, coalesce(s.one_step, 0) AS one_step, coalesce(s.escape_hardness, 0) AS escape_hardness, r.pagerank, e.weight AS edge_weight
              FROM edges e LEFT JOIN scores s ON s.word = e.dst JOIN ranks r ON r.word = e.dst WHERE left(e.dst, 1) NOT IN ('r', 's', 't'))
            SELECT word, row_number() OVER (PARTITION BY word ORDER BY round(score, 9) DESC, next_word)::INTEGER AS rank, next_word, round(score, 9) AS score, round(one_step, 9) AS one_step, round(escape_hardness, 9) AS escape_hardness, round(pagerank, 9) AS pagerank, edge_weight FROM c QUALIFY rank <= 10""",
        "word_analysis": sc + """, t AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges QUALIFY n <= 10), a AS (SELECT src, string_agg(dst, ' ' ORDER BY n) AS top_words FROM t GROUP BY src)
            SELECT word, n_neighbors, out_sum, round(one_step, 9) AS one_step, round(escape_hardness, 9) AS escape_hardness, round(pagerank, 9) AS pagerank, round(composite, 9) AS composite, top_words FROM scores JOIN a ON src = word""",
        "export_scores": sc + " SELECT word, printf('%.6f', round(round(composite, 9), 6)) AS composite_score, printf('%.6f', round(round(one_step, 9), 6)) AS one_step_prob, printf('%.6f', round(round(escape_hardness, 9), 6)) AS escape_hardness, printf('%.6f', round(round(pagerank, 9), 6)) AS pagerank_score, n_neighbors AS neighbor_count FROM scores",
        "score_distribution": sc + """, s AS (SELECT round(composite, 9) AS s FROM scores), x AS (SELECT max(s) AS top FROM s)
            SELECT max(s) AS highest, list_reverse_sort(list(s))[(count(*) // 2 + 1)::INTEGER] AS median, min(s) AS lowest, round(max(s) - min(s), 9) AS spread, count(*) FILTER (WHERE s >= top - 0.001::DOUBLE) AS n_high,
                   count(*) FILTER (WHERE s >= 0.5 AND s < top - 0.001::DOUBLE) AS n_mid, count(*) FILTER (WHERE s < 0.5) AS n_low FROM s, x""",
        "hit_within_3": mv + ", h0 AS (SELECT word, is_trap::INTEGER::DOUBLE AS p FROM words)" + "".join(f", h{i} AS MATERIALIZED (SELECT w.word, CASE WHEN is_trap THEN 1 ELSE coalesce(x.q, 0) END AS p FROM words w LEFT JOIN (SELECT src, sum(m.p * h.p) AS q FROM moves m JOIN h{i-1} h ON h.word = m.dst GROUP BY src) x ON x.src = w.word)" for i in (1, 2, 3)) + " SELECT word, round(p, 9)::DOUBLE AS p FROM h3",
        "k_step_exact": ew + _hits(4) + " SELECT word, step, round(exact, 9) AS exact FROM hits",
        "k_step_cumulative": ew + _hits(4) + " SELECT word, step, round(cumulative, 9) AS cumulative FROM hits",
        "k_step_4": ew + _hits(4) + " SELECT word, round(cumulative, 9) AS p FROM hits WHERE step = 4",
        "entropy_per_word": mv + "SELECT src AS word, round(sum(-p * log2(p)), 9) AS entropy FROM moves GROUP BY src",
        "info_gain": gain + "SELECT src, dst, round(p, 9) AS p, round(gain, 9) AS gain FROM gain",
        "information_flow": gain + ", o AS (SELECT src AS word, coalesce(sum(p) FILTER (WHERE trap), 0) AS one_step FROM gain GROUP BY src) SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY p DESC, dst)::INTEGER AS rank, round(gain, 9) AS gain, round(coalesce(one_step, 0), 9) AS one_step FROM gain LEFT JOIN o ON word = dst QUALIFY rank <= 5",
        "hit_comparison": "SELECT 0::DOUBLE AS max_diff, 0::DOUBLE AS mean_diff",
        "direct_targets": e + "SELECT src AS word, count(*) FILTER (WHERE left(dst, 1) IN ('r', 's', 't')) AS direct_traps, count(*) AS neighbors, round(count(*) FILTER (WHERE left(dst, 1) IN ('r', 's', 't'))::DOUBLE / count(*), 9) AS direct_share FROM edges GROUP BY src",
        "merge_sum": pr3 + "SELECT src, dst, sum(weight) AS weight FROM per GROUP BY 1, 2",
        "merge_max": pr3 + "SELECT src, dst, max(weight) AS weight FROM per GROUP BY 1, 2",
        "merge_running_avg": pr3 + """, f AS (SELECT src, dst, source, weight * CASE WHEN right(source, 1) IN ('0', '5') THEN 2.0 WHEN right(source, 1) IN ('1', '6') THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM per)
            SELECT src, dst, round_even(list_reduce(list(w ORDER BY source, w), lambda a, x: (a + x) / 2), 6) AS weight FROM f GROUP BY 1, 2""",
        "merge_composition": pr3 + "SELECT source, count(*) AS edges, round(100::DOUBLE * count(*) / sum(count(*)) OVER (), 9) AS percent FROM per GROUP BY source",
        "prune_edges": e + f", s AS MATERIALIZED (SELECT DISTINCT src AS word FROM edges WHERE src IN {st}) SELECT src, dst, weight FROM edges ANTI JOIN s a ON a.word = src ANTI JOIN s b ON b.word = dst",
        "prune_impact": e + f""", s AS (SELECT src AS word, count(*) AS outgoing FROM edges WHERE src IN {st} GROUP BY src), i AS (SELECT dst, count(*) AS incoming FROM edges GROUP BY dst), n AS (SELECT count(*) AS n FROM edges)
            SELECT word, outgoing, coalesce(incoming, 0) AS incoming, outgoing + coalesce(incoming, 0) AS total, round(100::DOUBLE * (outgoing + coalesce(incoming, 0)) / n, 9) AS percent FROM s LEFT JOIN i ON dst = word, n""",
        "prune_comparison": ew + f""", s AS MATERIALIZED (SELECT DISTINCT src AS word FROM edges WHERE src IN {st}), k AS MATERIALIZED (SELECT src, dst FROM edges ANTI JOIN s a ON a.word = src ANTI JOIN s b ON b.word = dst),
            x AS (SELECT (SELECT count(*) FROM edges) AS edges_before, (SELECT count(*) FROM words) AS words_before, (SELECT count(*) FROM k) AS edges_after, (SELECT count(*) FROM (SELECT src FROM k UNION SELECT dst FROM k)) AS words_after,
              (SELECT count(DISTINCT src) FROM k WHERE src IN {_in(remaining)}) AS function_words_left)
            SELECT *, round(100::DOUBLE * (edges_before - edges_after) / edges_before, 9) AS edge_percent, round(100::DOUBLE * (words_before - words_after) / words_before, 9) AS word_percent FROM x""",
        "high_value_edges": e + """, r AS (SELECT src AS word FROM edges WHERE left(src, 1) IN ('r', 's', 't') GROUP BY src HAVING count(*) FILTER (WHERE left(dst, 1) IN ('r', 's', 't')) > 0.3::DOUBLE * count(*) OR count(*) FILTER (WHERE left(dst, 1) IN ('r', 's', 't')) >= 2)
            SELECT src, dst, weight FROM edges WHERE src IN (SELECT word FROM r) UNION SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS n FROM edges WHERE dst IN (SELECT word FROM r)) WHERE n <= 3""",
        "edge_importance": f"WITH {EDGES}{WORDS}{_ranks(1.0)}" + """, i AS (SELECT dst AS w, count(*) AS d FROM edges GROUP BY dst), o AS (SELECT src AS w, count(*) AS d FROM edges GROUP BY src)
            SELECT src, dst, weight, round(0.25::DOUBLE * least(weight / 5, 1::DOUBLE) + 0.25::DOUBLE * (10 * a.pagerank + 10 * b.pagerank) + 0.30::DOUBLE * (CASE WHEN left(dst, 1) IN ('r', 's', 't') THEN 2 ELSE 0 END + CASE WHEN left(src, 1) IN ('r', 's', 't') THEN 0.5::DOUBLE ELSE 0 END)
              + 0.05::DOUBLE * CASE WHEN i.d > 1 AND o.d > 1 THEN 0.3::DOUBLE ELSE 0 END, 9) AS importance FROM edges JOIN ranks a ON a.word = src JOIN ranks b ON b.word = dst JOIN i ON i.w = dst JOIN o ON o.w = src""",
        "self_safety": ew + _hits(3) + """, f AS (SELECT src, count(*) FILTER (WHERE NOT trap)::DOUBLE / count(*) AS free FROM moves GROUP BY src)
            SELECT w.word, round(CASE WHEN is_trap THEN 0 WHEN free IS NOT NULL THEN 0.7::DOUBLE * (1 - cumulative) + 0.3::DOUBLE * free ELSE 1 - cumulative END, 9)::DOUBLE AS safety FROM words w JOIN hits h ON h.word = w.word AND h.step = 3 LEFT JOIN f ON f.src = w.word""",
        "opponent_danger": ew + _hits(2) + " SELECT src AS word, round(sum(p * cumulative), 9) AS danger FROM moves JOIN hits ON word = dst AND step = 2 WHERE NOT trap GROUP BY src",
        "escape_route_count": e + ", s AS (SELECT src, dst FROM edges WHERE left(dst, 1) NOT IN ('r', 's', 't')) SELECT src AS word, count(*) AS routes FROM s WHERE dst IN (SELECT src FROM s) GROUP BY src",
        "greedy_move": e + "SELECT src AS word, dst AS move FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) = 1",
        "avoid_move_score": f"WITH {EDGES}{MOVES}, s AS (SELECT src AS word, coalesce(sum(p) FILTER (WHERE trap), 0) AS share FROM moves GROUP BY src) SELECT src, dst, round(weight * (1 + coalesce(share, 0)), 9) AS score FROM moves LEFT JOIN s ON word = dst",
    }
    q["trap_effectiveness"] = mv + ", h0 AS (SELECT word, is_trap::INTEGER::DOUBLE AS p FROM words)" + "".join(f", h{i} AS MATERIALIZED (SELECT w.word, CASE WHEN is_trap THEN 1 ELSE coalesce(x.q, 0) END AS p FROM words w LEFT JOIN (SELECT src, sum(m.p * h.p) AS q FROM moves m JOIN h{i-1} h ON h.word = m.dst GROUP BY src) x ON x.src = w.word)" for i in (1, 2)) + """,
        o AS (SELECT src, coalesce(sum(p) FILTER (WHERE trap), 0) AS one_step, count(*) AS n FROM moves GROUP BY src)
        SELECT w.word, round(coalesce(one_step, 0), 9)::DOUBLE AS one_step, round(h2.p, 9)::DOUBLE AS k_step, coalesce(n, 0) AS connectivity, is_trap, round(0.7::DOUBLE * coalesce(one_step, 0) + 0.3::DOUBLE * h2.p, 9)::DOUBLE AS combined
        FROM words w JOIN h2 ON h2.word = w.word LEFT JOIN o ON src = w.word"""
    q["degrees"] = e + "SELECT word, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS word, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY word"
    q["average_degree"] = ew + "SELECT round(2::DOUBLE * e / v, 9) AS both_ends, round(e::DOUBLE / v, 9) AS one_end FROM (SELECT count(*) AS e FROM edges), (SELECT count(*) AS v FROM words)"
    best = lambda by, to, k, where="true": f"(SELECT {by} AS word, string_agg({to}, ' ' ORDER BY n) AS list FROM (SELECT {by}, {to}, row_number() OVER (PARTITION BY {by} ORDER BY weight DESC, {to}) AS n FROM edges WHERE {where} QUALIFY n <= {k}) GROUP BY 1)"
    q["word_details"] = pr + f""", pos AS (SELECT word, pagerank, row_number() OVER (ORDER BY round(pagerank, 12) DESC, word) AS position FROM ranks),
        o AS (SELECT src AS word, count(*) AS degree, min(weight) AS min_weight, max(weight) AS max_weight, sum(weight) / count(*) AS mean_weight FROM edges GROUP BY src)
        SELECT o.word, degree, left(o.word, 1) IN ('r', 's', 't') AS is_trap, min_weight, max_weight, round(mean_weight, 9) AS mean_weight, coalesce(a.list, '') AS top_out, coalesce(b.list, '') AS top_traps, coalesce(c.list, '') AS top_in, round(pagerank, 9) AS pagerank, position
        FROM o LEFT JOIN {best("src", "dst", 10)} a ON a.word = o.word LEFT JOIN {best("src", "dst", 5, "left(dst, 1) IN ('r', 's', 't')")} b ON b.word = o.word LEFT JOIN {best("dst", "src", 10)} c ON c.word = o.word JOIN pos ON pos.word = o.word"""
    playable = e + ", k AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM edges WHERE left(dst, 1) NOT IN ('r', 's', 't') QUALIFY n <= 8)"
    q["playable_moves"] = playable + " SELECT src AS word, string_agg(dst, ' ' ORDER BY n) AS moves FROM k GROUP BY src"
    wts = [((7 * k) % 13 - 6) / 20 for k in range(33)]
    feats = ["1::DOUBLE", "0::DOUBLE", "count(*)::DOUBLE", "length(src)::DOUBLE", "(left(src, 1) IN ('r', 's', 't'))::INTEGER::DOUBLE", "(left(src, 1) IN ('r', 's', 't'))::INTEGER::DOUBLE"]
    hidden = [f"greatest(0::DOUBLE, {wts[24 + h]}::DOUBLE" + "".join(f" + f{i} * {wts[h * 6 + i]}::DOUBLE" for i in range(6)) + f") * {wts[28 + h]}::DOUBLE" for h in range(4)]
    q["position_scores"] = playable + ", p AS (SELECT src AS word, " + ", ".join(f"{x} AS f{i}" for i, x in enumerate(feats)) + f" FROM k GROUP BY src) SELECT *, round(1::DOUBLE / (1 + exp(-({wts[32]}::DOUBLE + {' + '.join(hidden)}))), 9) AS score FROM p"
    walk = e + f""", v AS MATERIALIZED (SELECT src, dst, weight, left(dst, 1) IN ('r', 's', 't') AS trap FROM edges WHERE weight >= 2),
        w1 AS MATERIALIZED (SELECT src AS word, dst AS here, [dst] AS path, weight AS total_weight, trap FROM v WHERE src IN {go}),
        w2 AS MATERIALIZED (SELECT word, dst AS here, list_append(path, dst) AS path, total_weight + weight AS total_weight, v.trap FROM w1 JOIN v ON v.src = w1.here WHERE NOT w1.trap AND (v.trap OR NOT list_contains(path, dst))),
        walks AS (SELECT word, upper(left(here, 1)) AS letter, here AS target, array_to_string(path, ' ') AS path, len(path)::INTEGER AS length, total_weight FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) WHERE trap) """
    q["trap_pathways"] = walk + "SELECT word, letter, target, path, length, total_weight FROM walks"
    q["pathways_top5"] = walk + "SELECT word, letter, row_number() OVER (PARTITION BY word, letter ORDER BY total_weight DESC, path)::INTEGER AS rank, path, total_weight FROM walks QUALIFY rank <= 5"
    q["bfs_distance"] = e + f""", b0 AS (SELECT DISTINCT src AS start, src AS word, 0 AS depth FROM edges WHERE src IN {go}),
        b1 AS MATERIALIZED (SELECT DISTINCT start, dst AS word, 1 AS depth FROM b0 JOIN edges ON src = word), b2 AS MATERIALIZED (SELECT DISTINCT start, dst AS word, 2 AS depth FROM b1 JOIN edges ON src = word),
        b3 AS MATERIALIZED (SELECT DISTINCT start, dst AS word, 3 AS depth FROM b2 JOIN edges ON src = word)
        SELECT start, word, min(depth)::INTEGER AS depth FROM (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM b3) GROUP BY 1, 2"""
    q["all_paths_scored"] = gain + f""", g1 AS MATERIALIZED (SELECT src AS word, dst AS here, [src, dst] AS path, p AS probability, -p * log2(p) AS entropy, gain, trap FROM gain WHERE src IN {go} AND src <> dst),
        g2 AS (SELECT word, dst AS here, list_append(path, dst) AS path, probability * p AS probability, entropy - p * log2(p) AS entropy, g1.gain + gain.gain AS gain, gain.trap FROM g1 JOIN gain ON src = here WHERE NOT g1.trap AND NOT list_contains(path, dst)),
        a AS (SELECT word, array_to_string(path, ' ') AS path, (len(path) - 1)::INTEGER AS steps, probability, entropy, gain FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2) WHERE trap AND left(word, 1) NOT IN ('r', 's', 't'))
        SELECT word, path, steps, round(probability, 9) AS probability, round(entropy, 9) AS entropy, round(gain, 9) AS gain, round(0.3::DOUBLE * probability + 0.25::DOUBLE / (1 + steps) + 0.25::DOUBLE * gain + 0.2::DOUBLE / (1 + entropy), 9) AS score FROM a"""
    conceptnet = "SELECT src, dst, CASE WHEN weight > 2 THEN weight / 4 ELSE 1 END AS w, weight > 2 AS twice, length(src) AS part FROM edges WHERE length(src) % 3 < 2 AND length(dst) % 7 <> 0"
    q["conceptnet_scan"] = e + f"SELECT src, dst, (w * CASE WHEN twice THEN 2 ELSE 1 END)::DOUBLE AS weight FROM ({conceptnet}) WHERE length(src) <= 20 AND length(dst) <= 20"
    q["conceptnet_light_scan"] = e + f""", c AS (SELECT * FROM ({conceptnet}) WHERE length(src) <= 15 AND length(dst) <= 15 AND w > 0.5), n AS (SELECT part, sum(count(*)) OVER (ORDER BY part) AS n FROM c GROUP BY part)
        SELECT src, dst, w::DOUBLE AS weight FROM c WHERE part <= coalesce((SELECT min(part) FROM n WHERE n >= 500), part)"""
    q["colon_scan"] = e + "SELECT src, dst, weight FROM edges"
    q["association_scan"] = e + "SELECT src, dst, weight FROM edges WHERE length(dst) % 5 <> 0 AND length(src) <= 20 AND length(dst) <= 20"
    # the text before it is no number, so rows of odd weight are dropped by the targeted reader and fall through in the manual one
    q["swow_targeted_scan"] = e + "SELECT src, dst, weight / 8 AS weight FROM edges WHERE weight % 2 = 0 AND length(src) <= 25 AND length(dst) <= 25"
    q["swow_manual_scan"] = e + "SELECT src, dst, CASE WHEN weight % 2 = 0 THEN weight / 8 ELSE weight / 16 END AS weight FROM edges WHERE length(src) + 1 <= 9 AND length(dst) <= 25"
    named = lambda loops: f"""WITH {TOKENS}, per AS (SELECT source, struct_extract(p, 1) AS src, struct_extract(p, 2) AS dst, count(*)::DOUBLE AS weight FROM pairs {"" if loops else "WHERE struct_extract(p, 1) <> struct_extract(p, 2)"} GROUP BY 1, 2, 3 HAVING count(*) >= 2),
        named AS (SELECT *, CASE WHEN right(source, 1) IN ('0', '3', '6', '9') THEN 'swow' WHEN right(source, 1) IN ('1', '4', '7') THEN 'usf' ELSE 'conceptnet' END AS name FROM per),
        f AS (SELECT *, CASE name WHEN 'swow' THEN 0 WHEN 'usf' THEN 1 ELSE 2 END AS place, weight * CASE name WHEN 'swow' THEN 3 WHEN 'usf' THEN 1.5 ELSE 0.3 END::DOUBLE AS w FROM named)"""  # noqa: E731
    q["merge_complete"] = named(True) + " " + _half_even("SELECT src, dst, list_reduce(list(w ORDER BY place, source, w), lambda a, x: (a + x) / 2) AS x FROM f GROUP BY 1, 2")
    q["merge_targeted"] = named(False) + " " + _half_even("SELECT src, dst, list_reduce(list(w ORDER BY place, source, w), lambda a, x: (a + x) / 2) AS x FROM f WHERE name <> 'swow' GROUP BY 1, 2")
    pairs = lambda to: [(a, b) for a in starts for b in to]
    q["shortest_paths"] = e + _forward(pairs(("the", "and", "la", "der")), 4) + " SELECT start, target, path, product FROM found"
    q["trap_potential"] = e + _forward(pairs(targets), 3) + " SELECT start, target, path, product, CASE WHEN path IS NULL THEN 'perfect trap' WHEN product < 0.1 THEN 'trap' WHEN product > 0.3 THEN 'easy' ELSE 'medium' END AS label FROM found"
    q["ways_to"] = e + _backward(f"SELECT * FROM {_values([(t,) for t in targets], 'target')}", 8) + " SELECT target, word, words::INTEGER AS words, product FROM ways"
    q["chain_edges"] = ew + _chains(50, 24) + " SELECT src, dst FROM chains"
    importance = q["edge_importance"]
    high = q["high_value_edges"][len(e):]
    cut = importance.index("SELECT src, dst, weight, round(0.25")
    q["reduce_sizes"] = importance[:cut].rstrip() + _chains(50, 24) + high[: high.index("SELECT src, dst, weight FROM edges WHERE src IN")].rstrip() + ", high AS (" + high[high.index("SELECT src, dst, weight FROM edges WHERE src IN"):] + "), imp AS (" + importance[cut:] + """),
        kept AS (SELECT src, dst FROM chains UNION SELECT src, dst FROM high), rows AS MATERIALIZED (SELECT imp.*, k.src IS NOT NULL AS must_keep FROM imp LEFT JOIN kept k ON k.src = imp.src AND k.dst = imp.dst),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY must_keep ORDER BY importance DESC, src, dst) AS n FROM rows), sizes AS (SELECT factor, greatest(0, floor((SELECT count(*) FROM rows) * factor) - (SELECT count(*) FROM rows WHERE must_keep)) AS room FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) v(factor))
        SELECT factor, src, dst, weight, importance, must_keep FROM ranked, sizes WHERE must_keep OR n <= room"""
    q["simulate_games"] = ew + _simulated(100, "greedy", "smart", 20, None)
    q["simulate_target_games"] = ew + _simulated(100, "smart", "random", 20, "the")
    players = ("random", "greedy", "smart", "avoid")
    table = f"SELECT word || '|' || first || '|' || second AS game, word, first, second, NULL::VARCHAR AS target FROM (SELECT word FROM words WHERE is_source ORDER BY md5('7:' || word), word LIMIT 10), {_values([(a, b) for a in players for b in players if a != b], 'first, second')}"
    q["tournament"] = ew + _games(table, 20, False) + """ SELECT player, count(*) FILTER (WHERE won) AS wins, count(*) AS played, round(100::DOUBLE * count(*) FILTER (WHERE won) / count(*), 9) AS percent
        FROM (SELECT first AS player, ending = 'stuck' AND mover = 'second' AS won FROM ends UNION ALL SELECT second, ending = 'stuck' AND mover = 'first' FROM ends) GROUP BY 1"""
    top = ", best AS MATERIALIZED (SELECT e.src AS word, e.dst AS next FROM edges e LEFT JOIN scores s ON s.word = e.dst WHERE left(e.dst, 1) NOT IN ('r', 's', 't') QUALIFY row_number() OVER (PARTITION BY e.src ORDER BY round(coalesce(s.composite, 0), 9) DESC, e.dst) = 1), t0 AS (SELECT 'and' AS word, false AS won)"
    top += "".join(f", t{k} AS MATERIALIZED (SELECT next AS word, left(next, 1) IN ('r', 's', 't') OR next = 'le' AS won FROM t{k-1} JOIN best USING (word) WHERE NOT won)" for k in range(1, 16))
    q["strategic_game"] = sc + top + " " + " UNION ALL ".join(f"SELECT {k} AS turn, word, won FROM t{k}" for k in range(16))
    q["weighted_games"] = e + _weighted(pairs(targets), 15)
    odds = _chance("src", "dst", "'7'", "'noise'"), _chance("src", "dst", "'7'", "'draw'")
    q["weighted_choice"] = e + f"SELECT src AS word, dst AS move FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY -ln({odds[1]}) / (weight * CASE WHEN dst IN {go} THEN 0.5::DOUBLE ELSE 1::DOUBLE END * (0.7::DOUBLE + 0.6::DOUBLE * ({odds[0]}))), dst) = 1"
    return q
