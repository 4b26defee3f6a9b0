"""DuckDB SQL with the rows of the queries: one chain of common table expressions, and what each query selects from it."""

from __future__ import annotations

import re

from argolith.config import CONNECTIVES
from argolith.operators.reasoning import WHY
from argolith.queries.spark import BATCH_CHARS, CUES, PROFILE, THRESHOLDS


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def tokens(x: str) -> str:
    s = strip(f"lower({x})")
    return rf"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '\s+') END)"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect(list_distinct({tokens(a)}), list_distinct({tokens(b)})))"


def clean(x: str) -> str:
    for p in PROFILE.clean_patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def segments(x: str, least: int = PROFILE.min_words) -> str:
    """Separators become a character that does not occur, as look-around is not to be had here."""
    words = "|".join(CONNECTIVES)
    sentences = rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    clauses = f"flatten(list_transform({sentences}, lambda s: regexp_split_to_array(s, '[;:—]')))"
    parts = rf"flatten(list_transform({clauses}, lambda c: string_split(regexp_replace(c, ',\s*((?:{words})(?:[^\pL\pN_]|$))', chr(1) || '\1', 'g'), chr(1))))"
    return f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: len({tokens('p')}) > {least})"


K, W, T = PROFILE.k, PROFILE.implicit_window, PROFILE.threshold
CHAIN: dict[str, str] = {
    "posts": """SELECT conv_id::VARCHAR AS thread_id, turn::INT AS turn_pos, conv_id || '_' || turn AS post_id,
        coalesce(lag(conv_id || '_' || turn) OVER (PARTITION BY conv_id ORDER BY turn), '') AS parent_id,
        role AS speaker_id, coalesce(text, '') AS text FROM conversations""",
    "threads": f"""SELECT thread_id, array_to_string(list_slice({tokens('text')}, 1, 8), ' ') AS title, thread_id::BIGINT % 2 = 0 AS is_delta
        FROM (SELECT * FROM posts QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY turn_pos) = 1)""",
    "turns": f"SELECT * REPLACE ({clean('text')} AS text) FROM posts",
    "numbered_turns": "SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn_pos) AS k FROM turns WHERE text <> ''",
    "packed": f"""SELECT thread_id, turn_pos, k, text, 0::BIGINT AS batch, length(text)::BIGINT AS held FROM numbered_turns WHERE k = 1
        UNION ALL SELECT t.thread_id, t.turn_pos, t.k, t.text, p.batch + (p.held + length(t.text) > {BATCH_CHARS})::BIGINT,
          CASE WHEN p.held + length(t.text) > {BATCH_CHARS} THEN length(t.text) ELSE p.held + length(t.text) END
        FROM packed p JOIN numbered_turns t ON t.thread_id = p.thread_id AND t.k = p.k + 1""",
    "prompts": "SELECT thread_id, batch, string_agg(text, ' ' ORDER BY turn_pos) AS prompt FROM packed GROUP BY ALL",
    "raw_edus": f"SELECT thread_id, turn_pos, post_id, parent_id, speaker_id, unnest(e) AS edu, generate_subscripts(e, 1) - 1 AS pos FROM (SELECT *, {segments('text')} AS e FROM turns)",
    "deduped": "SELECT * FROM raw_edus QUALIFY row_number() OVER (PARTITION BY thread_id, turn_pos, lower(edu) ORDER BY pos) = 1",
    "edus": rf"""SELECT thread_id, turn_pos, post_id, parent_id, speaker_id, edu AS text,
        row_number() OVER (PARTITION BY thread_id, turn_pos ORDER BY pos) - 1 AS local_idx
        FROM deduped WHERE NOT regexp_matches(edu, '{PROFILE.deleted_regex}') AND len({tokens('edu')}) > {PROFILE.min_words}""",
    "central": f"""SELECT t.thread_id, b.text AS central_proposition, CASE WHEN b.text IS NOT NULL THEN 'overlap' END AS method FROM threads t LEFT JOIN (
        SELECT e.thread_id, e.text FROM edus e JOIN threads USING (thread_id)
        JOIN (SELECT thread_id, min(turn_pos) AS turn_pos FROM turns GROUP BY ALL) USING (thread_id, turn_pos)
        QUALIFY row_number() OVER (PARTITION BY e.thread_id ORDER BY {overlap('e.text', 'title')} DESC, local_idx) = 1) b USING (thread_id)""",
    "idx": f"""SELECT e.*, row_number() OVER (PARTITION BY thread_id ORDER BY turn_pos, local_idx) - 1 AS global_idx,
        coalesce({strip('e.text')} = {strip('central_proposition')}, false) AS is_central_prop FROM edus e LEFT JOIN central USING (thread_id)""",
    "terms": f"SELECT thread_id, global_idx, term, count(*) AS tf FROM (SELECT thread_id, global_idx, unnest({tokens('text')}) AS term FROM idx) GROUP BY ALL",
    "norms": "SELECT thread_id, global_idx, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM terms GROUP BY ALL",
    "dots": """SELECT a.thread_id, a.global_idx AS a, b.global_idx AS b, sum(a.tf * b.tf)::DOUBLE / (any_value(x.norm) * any_value(y.norm)) AS sim
        FROM terms a JOIN terms b ON a.thread_id = b.thread_id AND a.term = b.term AND a.global_idx <> b.global_idx
        JOIN norms x ON x.thread_id = a.thread_id AND x.global_idx = a.global_idx JOIN norms y ON y.thread_id = b.thread_id AND y.global_idx = b.global_idx GROUP BY ALL""",
    "scoped": """SELECT t.thread_id, t.global_idx AS target_idx, s.global_idx AS source_idx, 'INTRA' AS pac_scope, s.text AS source_text
        FROM idx t JOIN idx s ON t.thread_id = s.thread_id AND t.post_id = s.post_id AND t.global_idx <> s.global_idx WHERE NOT s.is_central_prop
        UNION ALL SELECT t.thread_id, t.global_idx, s.global_idx, 'INTER', s.text
        FROM idx t JOIN idx s ON t.thread_id = s.thread_id AND s.parent_id = t.post_id AND s.post_id <> t.post_id AND s.global_idx > t.global_idx WHERE NOT s.is_central_prop""",
    "pairs": "SELECT p.*, coalesce(d.sim, 0.0) AS sim FROM scoped p LEFT JOIN dots d ON d.thread_id = p.thread_id AND d.a = target_idx AND d.b = source_idx",
    "best": "SELECT i.thread_id, i.global_idx AS target_idx, coalesce(max(sim), 0.0) AS best FROM idx i LEFT JOIN pairs p ON p.thread_id = i.thread_id AND p.target_idx = i.global_idx GROUP BY ALL",
    "sides": f"""SELECT p.*, source_idx < target_idx AS before, count(*) FILTER (source_idx < target_idx) OVER (PARTITION BY thread_id, target_idx) AS n_before
        FROM pairs p JOIN best USING (thread_id, target_idx) WHERE best < {T} AND pac_scope = 'INTRA'""",
    "ranked_sides": """SELECT *, row_number() OVER (PARTITION BY thread_id, target_idx, before ORDER BY source_idx DESC) AS back,
        row_number() OVER (PARTITION BY thread_id, target_idx, before ORDER BY source_idx) AS ahead FROM sides""",
    "implicit": f"""SELECT thread_id, target_idx, source_idx, pac_scope, source_text, sim, 'IMPLICIT' AS selection_type,
        row_number() OVER (PARTITION BY thread_id, target_idx ORDER BY source_idx) - 1 AS pac_pos
        FROM ranked_sides WHERE CASE WHEN before THEN back <= {W} ELSE ahead <= greatest({W} - n_before, 0) END""",
    "top": f"SELECT *, row_number() OVER (PARTITION BY thread_id, target_idx, pac_scope ORDER BY sim DESC, source_idx) AS k FROM pairs WHERE sim >= {T} QUALIFY k <= {K}",
    "semantic": """SELECT thread_id, target_idx, source_idx, pac_scope, source_text, sim, 'SEMANTIC' AS selection_type,
        row_number() OVER (PARTITION BY thread_id, target_idx ORDER BY pac_scope DESC, k) - 1 AS pac_pos FROM top""",
    "pacs": "SELECT *, round(sim, 4) AS cosine_sim FROM (SELECT * FROM implicit UNION ALL SELECT * FROM semantic)",
    "relations": f"""SELECT *, CASE WHEN len(list_intersect({tokens('source_text')}, {list(CUES)})) > 0 THEN 'attack'
        WHEN cosine_sim >= 0.25 THEN 'support' ELSE 'neutral' END AS relation FROM pacs""",
    "counted": """SELECT thread_id, target_idx, count(*) FILTER (relation = 'support') AS support, count(*) FILTER (relation = 'attack') AS attack,
        count(*) FILTER (relation = 'neutral') AS neutral FROM relations GROUP BY ALL""",
    "expected": "SELECT thread_id || '_' || (target_idx // 10) AS batch_id, target_idx, pac_pos AS source_idx FROM pacs",
    "votes": """SELECT *, ['support', 'attack', 'neutral'][((target_idx * 7 + source_idx * 3 + CASE WHEN (target_idx + source_idx) % 5 = 0 THEN call_no ELSE 0 END) % 3 + 1)::INT] AS relation
        FROM expected, (SELECT unnest([1, 2, 3]) AS call_no)""",
    "calls": """SELECT batch_id, target_idx, source_idx, max(relation) FILTER (call_no = 1) AS call1, max(relation) FILTER (call_no = 2) AS call2, max(relation) FILTER (call_no = 3) AS call3
        FROM votes GROUP BY ALL""",
    "edges": """SELECT thread_id, least(source_idx, target_idx) AS source_idx, greatest(source_idx, target_idx) AS target_idx,
        CASE WHEN max((source_idx < target_idx)::INT * 2 + (relation = 'attack')::INT) % 2 = 1 THEN 'attack' ELSE 'support' END AS relation
        FROM relations WHERE relation <> 'neutral' AND source_idx <> target_idx GROUP BY ALL""",
    "nodes": """SELECT i.* FROM idx i WHERE (thread_id, global_idx) IN (SELECT thread_id, source_idx FROM edges UNION SELECT thread_id, target_idx FROM edges
        UNION SELECT thread_id, min(global_idx) FROM idx WHERE is_central_prop GROUP BY ALL)""",
    "roots": "SELECT thread_id, coalesce(min(global_idx) FILTER (is_central_prop), min(global_idx)) AS root_idx FROM nodes GROUP BY ALL",
    "reach": """SELECT thread_id, global_idx AS a, global_idx AS b FROM nodes
        UNION SELECT r.thread_id, r.a, e.y FROM reach r JOIN (SELECT thread_id, source_idx AS x, target_idx AS y FROM edges UNION SELECT thread_id, target_idx, source_idx FROM edges) e
        ON e.thread_id = r.thread_id AND e.x = r.b""",
    "comps": """SELECT *, dense_rank() OVER (PARTITION BY thread_id ORDER BY size DESC, component) AS rank FROM (
        SELECT thread_id, a AS global_idx, min(b) AS component, count(*) AS size FROM reach GROUP BY ALL)""",
    "links": """SELECT x.thread_id, x.rank, x.global_idx AS a, y.global_idx AS b, coalesce(d.sim, 0.0) AS sim FROM comps x
        JOIN comps y ON x.thread_id = y.thread_id AND x.rank > y.rank LEFT JOIN dots d ON d.thread_id = x.thread_id AND d.a = x.global_idx AND d.b = y.global_idx
        QUALIFY row_number() OVER (PARTITION BY x.thread_id, x.rank ORDER BY coalesce(d.sim, 0.0) DESC, y.global_idx, x.global_idx) = 1""",
    "repairs": "SELECT thread_id, least(a, b) AS source_idx, greatest(a, b) AS target_idx, CASE WHEN sim >= 0 THEN 'support' ELSE 'attack' END AS relation FROM links",
    "main": "SELECT n.* FROM nodes n JOIN comps c USING (thread_id, global_idx) JOIN roots USING (thread_id) JOIN comps r ON r.thread_id = n.thread_id AND r.global_idx = root_idx WHERE c.component = r.component",
    "large": f"SELECT thread_id, count(*) AS units FROM main GROUP BY ALL HAVING count(*) > {PROFILE.min_units}",
    "both_nodes": """SELECT n.*, root_idx, global_idx = root_idx AS is_root FROM (SELECT *, 'repair' AS mode FROM nodes UNION ALL
        SELECT m.*, 'no_repair' FROM main m WHERE thread_id IN (SELECT thread_id FROM large)) n JOIN roots USING (thread_id)""",
    "both_edges": """SELECT *, false AS synthetic, 'repair' AS mode FROM edges UNION ALL SELECT *, true, 'repair' FROM repairs UNION ALL
        SELECT e.*, false, 'no_repair' FROM edges e WHERE (thread_id, source_idx) IN (SELECT thread_id, global_idx FROM both_nodes WHERE mode = 'no_repair')""",
    "both_degrees": """SELECT n.*, (SELECT count(*) FROM both_edges e WHERE e.thread_id = n.thread_id AND e.mode = n.mode AND e.target_idx = n.global_idx) AS in_degree,
        (SELECT count(*) FROM both_edges e WHERE e.thread_id = n.thread_id AND e.mode = n.mode AND e.source_idx = n.global_idx) AS out_degree FROM both_nodes n""",
    "entropies": """SELECT i.thread_id, i.global_idx, coalesce(e.entropy, 0.0) AS entropy FROM idx i LEFT JOIN (
        SELECT thread_id, global_idx, abs(-sum(tf / n * log2(tf / n))) AS entropy FROM (SELECT *, sum(tf) OVER (PARTITION BY thread_id, global_idx)::DOUBLE AS n FROM terms) GROUP BY ALL) e USING (thread_id, global_idx)""",
    "explicit": """SELECT n.thread_id, n.mode, n.global_idx, CASE WHEN max(entropy) OVER g <= 0 THEN 1.0 ELSE 1 - entropy / max(entropy) OVER g END AS explicitness
        FROM both_nodes n JOIN entropies USING (thread_id, global_idx) WINDOW g AS (PARTITION BY n.thread_id, n.mode)""",
    "ancestors": """SELECT thread_id, mode, target_idx AS global_idx, source_idx AS ancestor, 1 AS depth FROM both_edges
        UNION SELECT a.thread_id, a.mode, a.global_idx, e.source_idx, a.depth + 1 FROM ancestors a JOIN both_edges e ON e.thread_id = a.thread_id AND e.mode = a.mode AND e.target_idx = a.ancestor""",
    "hops": """SELECT thread_id, mode, target_idx AS global_idx, source_idx AS other, 1 AS depth FROM both_edges WHERE relation = 'support'
        UNION ALL SELECT thread_id, mode, source_idx, target_idx, 2 FROM both_edges WHERE relation = 'support'
        UNION ALL SELECT x.thread_id, x.mode, x.source_idx, y.target_idx, 3 FROM both_edges x JOIN both_edges y ON y.thread_id = x.thread_id AND y.mode = x.mode AND y.source_idx = x.target_idx
        WHERE x.relation = 'attack' AND y.relation = 'attack'""",
    "turned": """SELECT e.thread_id, e.mode, CASE WHEN r.root_idx = e.source_idx THEN e.target_idx ELSE e.source_idx END AS source_idx,
        CASE WHEN r.root_idx = e.source_idx THEN e.source_idx ELSE e.target_idx END AS target_idx, relation, synthetic
        FROM both_edges e LEFT JOIN (SELECT thread_id, mode, global_idx AS root_idx FROM both_degrees WHERE is_root AND in_degree = 0 AND out_degree > 0) r ON r.thread_id = e.thread_id AND r.mode = e.mode""",
    "weighted": f"""SELECT *, w / sum(w) OVER (PARTITION BY thread_id, mode, target_idx, relation) AS weight
        FROM (SELECT *, CASE WHEN synthetic THEN {PROFILE.synthetic_weight} ELSE 1.0 END::DOUBLE AS w FROM turned)""",
    "round0": "SELECT thread_id, mode, global_idx, (1.0 / (1 + global_idx % 3))::DOUBLE AS b, (1.0 / (1 + global_idx % 3))::DOUBLE AS s FROM both_nodes",
}
for _n in range(5):
    CHAIN[f"round{_n + 1}"] = f"""SELECT n.thread_id, n.mode, n.global_idx, n.b, {1 - PROFILE.lam} * any_value(n.s) + {PROFILE.lam} / (1 + exp(-({PROFILE.beta} * n.b
          + coalesce(sum(exp(m.s / {PROFILE.tau_agg}) * weight * m.s) FILTER (relation = 'support') / sum(exp(m.s / {PROFILE.tau_agg})) FILTER (relation = 'support'), 0)
          - coalesce(sum(exp(m.s / {PROFILE.tau_agg}) * weight * m.s) FILTER (relation = 'attack') / sum(exp(m.s / {PROFILE.tau_agg})) FILTER (relation = 'attack'), 0)) / {PROFILE.tau})) AS s
        FROM round{_n} n LEFT JOIN weighted e ON e.thread_id = n.thread_id AND e.mode = n.mode AND e.target_idx = n.global_idx
        LEFT JOIN round{_n} m ON m.thread_id = e.thread_id AND m.mode = e.mode AND m.global_idx = e.source_idx GROUP BY n.thread_id, n.mode, n.global_idx, n.b"""
ALPHA, TOL = PROFILE.damping, 1e-6
CHAIN |= {
    "lists": "SELECT thread_id, mode, list(global_idx ORDER BY global_idx) AS ids, count(*)::INT AS n FROM both_nodes GROUP BY ALL",
    "spots": "SELECT e.thread_id, e.mode, list_position(ids, source_idx) AS a, list_position(ids, target_idx) AS b FROM both_edges e JOIN lists USING (thread_id, mode)",
    "around": """SELECT thread_id, mode, list(coalesce(o, 0) ORDER BY k) AS outs, list(coalesce(i, []) ORDER BY k) AS ins FROM (SELECT thread_id, mode, unnest(range(1, n + 1)) AS k FROM lists) x
        LEFT JOIN (SELECT thread_id, mode, a AS k, count(*) AS o FROM spots GROUP BY ALL) USING (thread_id, mode, k) LEFT JOIN (SELECT thread_id, mode, b AS k, list(a) AS i FROM spots GROUP BY ALL) USING (thread_id, mode, k) GROUP BY ALL""",
    "ranking": f"""SELECT thread_id, mode, ids, n, outs, ins, [1.0::DOUBLE / n for k in ids] AS x, 0 AS t, false AS done FROM lists JOIN around USING (thread_id, mode)
        UNION ALL SELECT thread_id, mode, ids, n, outs, ins, y, t + 1, list_sum([abs(y[k] - x[k]) for k in range(1, n + 1)]) < n * {TOL} FROM (
          SELECT *, [{ALPHA} * (coalesce(list_sum([x[j] / outs[j] for j in ins[k]]), 0) + held / n) + {1 - ALPHA} / n for k in range(1, n + 1)] AS y FROM (
            SELECT *, coalesce(list_sum([x[j] for j in range(1, n + 1) if outs[j] = 0]), 0) AS held FROM ranking WHERE NOT done AND t < 100))""",
    "ranks": "SELECT thread_id, mode, unnest(ids) AS global_idx, unnest(x) AS pagerank FROM ranking WHERE done",
    "raw2": f"""SELECT n.thread_id, n.mode, n.global_idx, n.is_root, coalesce(sum(p.pagerank * CASE WHEN d.speaker_id = r.speaker_id THEN {1 + PROFILE.op_bonus} ELSE 1.0 END * (1 + {PROFILE.depth_bonus} / a.depth)), 0) AS raw
        FROM both_nodes n JOIN both_nodes r ON r.thread_id = n.thread_id AND r.mode = n.mode AND r.is_root
        LEFT JOIN (SELECT thread_id, mode, global_idx, ancestor, min(depth)::DOUBLE AS depth FROM ancestors WHERE ancestor <> global_idx GROUP BY ALL) a ON a.thread_id = n.thread_id AND a.mode = n.mode AND a.global_idx = n.global_idx
        LEFT JOIN ranks p ON p.thread_id = a.thread_id AND p.mode = a.mode AND p.global_idx = a.ancestor
        LEFT JOIN both_nodes d ON d.thread_id = a.thread_id AND d.mode = a.mode AND d.global_idx = a.ancestor GROUP BY n.thread_id, n.mode, n.global_idx, n.is_root""",
    "expanded": f"""SELECT h.thread_id, h.mode, h.global_idx, h.other, h.depth FROM hops h JOIN explicit w USING (thread_id, mode, global_idx)
        JOIN explicit g ON g.thread_id = h.thread_id AND g.mode = h.mode AND g.global_idx = h.other WHERE h.global_idx <> h.other AND w.explicitness < {PROFILE.explicit_at} AND g.explicitness >= {PROFILE.explicit_at}
        QUALIFY row_number() OVER (PARTITION BY h.thread_id, h.mode, h.global_idx ORDER BY h.depth, round(g.explicitness, 9) DESC, h.other) = 1""",
    "units": "SELECT thread_id, global_idx, term, tf / norm AS u FROM terms JOIN norms USING (thread_id, global_idx)",
    "moved": f"""SELECT thread_id, mode, global_idx, term, sum(u) AS w FROM (SELECT n.thread_id, n.mode, n.global_idx, term, u FROM both_nodes n JOIN units USING (thread_id, global_idx)
        UNION ALL SELECT x.thread_id, x.mode, x.global_idx, term, u * pow({PROFILE.context_decay}, x.depth) FROM expanded x JOIN units v ON v.thread_id = x.thread_id AND v.global_idx = x.other) GROUP BY ALL""",
    "cvecs": "SELECT thread_id, mode, global_idx, term, w / sqrt(sum(w * w) OVER (PARTITION BY thread_id, mode, global_idx)) AS w FROM moved",
    "sims": """SELECT e.thread_id, e.mode, e.source_idx, e.target_idx, coalesce(sum(a.w * b.w), 0) AS sim FROM both_edges e
        LEFT JOIN cvecs a ON a.thread_id = e.thread_id AND a.mode = e.mode AND a.global_idx = e.source_idx
        LEFT JOIN cvecs b ON b.thread_id = e.thread_id AND b.mode = e.mode AND b.global_idx = e.target_idx AND b.term = a.term GROUP BY ALL""",
    "raw3": f"""SELECT n.thread_id, n.mode, n.global_idx, n.is_root, {PROFILE.local_share} * coalesce(l.near, 0) + {1 - PROFILE.local_share} * CASE WHEN n.global_idx = n.root_idx THEN 1.0 ELSE coalesce(d.sim, 0) END AS raw FROM both_nodes n
        LEFT JOIN (SELECT thread_id, mode, source_idx AS global_idx, {1 - PROFILE.local_mean} * max(sim) + {PROFILE.local_mean} * avg(sim) AS near FROM sims GROUP BY ALL) l USING (thread_id, mode, global_idx)
        LEFT JOIN dots d ON d.thread_id = n.thread_id AND d.a = n.global_idx AND d.b = n.root_idx""",
}


def scaled(source: str, name: str, root: bool = True) -> str:
    inner = "CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (raw - lo) / (hi - lo) END"
    inner = f"CASE WHEN is_root THEN 1.0 ELSE {inner} END" if root else inner
    return f"SELECT thread_id, mode, global_idx, round({inner}, 6)::DOUBLE AS {name} FROM (SELECT *, min(raw) OVER g AS lo, max(raw) OVER g AS hi FROM {source} WINDOW g AS (PARTITION BY thread_id, mode))"


CHAIN |= {
    "s2s": scaled("raw2", "s2"),
    "s3s": scaled("raw3", "s3"),
    "raw4": f"SELECT *, s3 * (1 + {PROFILE.amplify} * s2) AS raw FROM s2s JOIN s3s USING (thread_id, mode, global_idx)",
    "s4s": scaled("raw4", "s4", False),
    "starts": """SELECT thread_id, mode, global_idx, 's1' AS strategy, 1.0::DOUBLE AS b FROM both_nodes UNION ALL SELECT thread_id, mode, global_idx, 's2', s2 FROM s2s
        UNION ALL SELECT thread_id, mode, global_idx, 's3', s3 FROM s3s UNION ALL SELECT thread_id, mode, global_idx, 's4', s4 FROM s4s""",
    "pulls": """SELECT e.thread_id, e.mode, list_position(ids, target_idx) AS k, list({'j': list_position(ids, source_idx), 'w': weight}) FILTER (relation = 'support') AS sup, list({'j': list_position(ids, source_idx), 'w': weight}) FILTER (relation = 'attack') AS att
        FROM weighted e JOIN lists USING (thread_id, mode) GROUP BY ALL""",
    "pulled": """SELECT thread_id, mode, list(coalesce(sup, []) ORDER BY k) AS sup, list(coalesce(att, []) ORDER BY k) AS att FROM (SELECT thread_id, mode, unnest(range(1, n + 1)) AS k FROM lists) x LEFT JOIN pulls USING (thread_id, mode, k) GROUP BY ALL""",
    "settling": f"""SELECT thread_id, mode, strategy, n, sup, att, b, b AS s, 0 AS t, 1e9::DOUBLE AS delta FROM (SELECT thread_id, mode, strategy, list(b ORDER BY global_idx) AS b FROM starts GROUP BY ALL) JOIN lists USING (thread_id, mode) JOIN pulled USING (thread_id, mode)
        UNION ALL SELECT thread_id, mode, strategy, n, sup, att, b, y, t + 1, list_max([abs(y[k] - s[k]) for k in range(1, n + 1)]) FROM (
          SELECT *, [{1 - PROFILE.lam} * s[k] + {PROFILE.lam} / (1 + exp(-({PROFILE.beta} * b[k]
            + coalesce(list_sum([exp(s[p.j] / {PROFILE.tau_agg}) * p.w * s[p.j] for p in sup[k]]) / list_sum([exp(s[p.j] / {PROFILE.tau_agg}) for p in sup[k]]), 0)
            - coalesce(list_sum([exp(s[p.j] / {PROFILE.tau_agg}) * p.w * s[p.j] for p in att[k]]) / list_sum([exp(s[p.j] / {PROFILE.tau_agg}) for p in att[k]]), 0)) / {PROFILE.tau})) for k in range(1, n + 1)] AS y
          FROM settling WHERE delta >= {PROFILE.eps} AND t < {PROFILE.max_iter})""",
    "settled": "SELECT * FROM settling QUALIFY row_number() OVER (PARTITION BY thread_id, mode, strategy ORDER BY t DESC) = 1",
    "ends": "SELECT thread_id, mode, strategy, unnest(ids) AS global_idx, unnest(b) AS initial_strength, round(unnest(s), 6) AS acceptability FROM settled JOIN lists USING (thread_id, mode)",
    "root_shifts": """SELECT e.thread_id, e.mode, strategy, 'edu_' || global_idx AS root_id, text AS root_text, initial_strength AS initial, acceptability AS final, round(acceptability - initial_strength, 6) AS delta, abs(round(acceptability - initial_strength, 6)) AS abs_delta
        FROM ends e JOIN both_nodes n USING (thread_id, mode, global_idx) WHERE is_root""",
    "root_votes": """SELECT thread_id, mode, threshold, count(*) FILTER (abs_delta >= threshold) AS votes, count(*) AS total, count(*) FILTER (abs_delta >= threshold) >= ceil(count(*) / 2) AS predicted
        FROM root_shifts, (SELECT unnest([0.1, 0.3, 0.5])::DOUBLE AS threshold) GROUP BY ALL""",
    "chosen": "SELECT thread_id, target_idx AS global_idx, list(source_text ORDER BY pac_pos) AS sources FROM pacs GROUP BY ALL",
    "items": """SELECT i.thread_id, i.global_idx, i.thread_id || '_' || (i.global_idx // 10) AS batch_id, i.global_idx % 10 AS pos, text, coalesce(sources, []) AS sources,
        coalesce(list(text) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS before, coalesce(list(text) OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS after
        FROM idx i LEFT JOIN chosen USING (thread_id, global_idx) WINDOW w AS (PARTITION BY i.thread_id, post_id ORDER BY local_idx)""",
}


def numbered(lines: str) -> str:
    return f"CASE WHEN len({lines}) > 0 THEN array_to_string(list_transform({lines}, lambda x, i: '  [' || (i - 1) || '] ' || x), chr(10)) ELSE '  (none)' END"


def asked(pos: str = "pos") -> str:
    """The text of one target."""
    return f"'Target [' || {pos} || ']' || chr(10) || text || chr(10) || 'Before it:' || chr(10) || {numbered('before')} || chr(10) || 'After it:' || chr(10) || {numbered('after')} || chr(10) || 'Sources:' || chr(10) || {numbered('sources')}"


CHAIN |= {
    "model_raw": f"""SELECT thread_id, batch, unnest(e) AS edu, generate_subscripts(e, 1) - 1 AS pos FROM (
        SELECT *, CASE WHEN length(prompt) % 3 = 0 THEN {segments('prompt')} ELSE list_filter(list_transform(string_split(prompt, '. '), lambda p: {strip('p')}), lambda p: p <> '') END AS e FROM prompts)""",
    "model_placed": f"""SELECT m.thread_id, m.batch, m.pos, p.turn_pos, edu FROM model_raw m JOIN packed p ON p.thread_id = m.thread_id AND p.batch = m.batch QUALIFY row_number() OVER (PARTITION BY m.thread_id, m.batch, m.pos
        ORDER BY contains(lower(p.text), lower(edu)) DESC, CASE WHEN contains(lower(p.text), lower(edu)) THEN 0 ELSE {overlap('edu', 'p.text')} END DESC, p.turn_pos) = 1""",
    "model_once": f"SELECT thread_id, turn_pos, batch, pos, {strip('edu')} AS text FROM model_placed QUALIFY row_number() OVER (PARTITION BY thread_id, turn_pos, lower({strip('edu')}) ORDER BY batch, pos) = 1",
    "opening": "SELECT thread_id, list(text ORDER BY local_idx) AS units FROM edus JOIN (SELECT thread_id, min(turn_pos) AS turn_pos FROM turns GROUP BY ALL) USING (thread_id, turn_pos) GROUP BY ALL",
    "judged": """SELECT c.*, split_part(c.batch_id, '_', -1)::INT AS number, c.target_idx % 10 AS place FROM calls c""",
    "heard": """SELECT *, NOT (number % 5 = 4 OR number % 4 = 1) AND bool_or(place % 6 <> 5) OVER b AS v1, NOT (number % 5 = 4 OR number % 4 = 2) AS v2, CASE WHEN place % 6 <> 5 THEN call1 END AS r1, call2 AS r2
        FROM judged WINDOW b AS (PARTITION BY batch_id)""",
    "argued": "SELECT *, coalesce(bool_or(v1 AND v2 AND r1 <> r2) OVER (PARTITION BY batch_id), false) AS dispute FROM heard",
    "ruled": """SELECT batch_id, target_idx, source_idx, CASE WHEN NOT v1 AND NOT v2 THEN CASE WHEN number % 2 = 0 THEN 'attack' END WHEN v1 AND NOT v2 THEN r1 WHEN v2 AND NOT v1 THEN r2 WHEN dispute AND r1 IS NULL THEN 'neutral'
          WHEN dispute AND r1 <> r2 THEN CASE WHEN number % 2 = 0 THEN 'attack' ELSE r1 END ELSE r1 END AS r,
          CASE WHEN NOT v1 AND NOT v2 THEN 'third' WHEN NOT v1 OR NOT v2 THEN 'single' WHEN dispute AND r1 IS NULL THEN 'left_out' WHEN dispute AND r1 <> r2 THEN CASE WHEN number % 2 = 0 THEN 'tiebreak' ELSE 'call1' END ELSE 'agreed' END AS m FROM argued""",
    "calm": "SELECT r.* REPLACE (CASE WHEN is_central_prop THEN 'neutral' ELSE relation END AS relation) FROM relations r JOIN idx i ON i.thread_id = r.thread_id AND i.global_idx = r.target_idx",
    "reviewed": "SELECT thread_id, min(global_idx) AS target_idx FROM idx WHERE is_central_prop GROUP BY ALL",
    "spoken": """SELECT *, CASE WHEN turn_pos = 0 THEN 0 ELSE turn_pos % 4 END AS who, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '\\. ', '.' || chr(10) || '  ', 'g'), '\\s*\\n\\s*', ' ', 'g'), '\\s{2,}', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS body FROM posts""",
    "heard_turns": """SELECT thread_id, min(turn_pos) FILTER (who IN (0, 3)) AS q, min(turn_pos) FILTER (who = 1) AS r FROM spoken WHERE body <> '' GROUP BY ALL""",
    "interro": """SELECT s.thread_id, CASE s.turn_pos WHEN q THEN 1 WHEN r THEN 2 WHEN c THEN 3 END AS k, s.who, s.body FROM spoken s JOIN (SELECT thread_id, q, r, min(turn_pos) AS c FROM spoken JOIN heard_turns USING (thread_id) WHERE who IN (0, 3) AND body <> '' AND turn_pos > greatest(q, r) GROUP BY ALL) USING (thread_id)
        WHERE r IS NOT NULL AND s.turn_pos IN (q, r, c)""",
    "interro_posts": "SELECT *, '[Speaker ' || CASE k WHEN 2 THEN 2 ELSE 1 END || ' - ' || ['Question', 'Response', 'Counter-Reply'][k] || ']: ' || body AS said FROM interro",
}
CHAIN |= {
    "shifts": """SELECT *, abs(delta) AS abs_delta FROM (SELECT *, round(final - initial, 6) AS delta FROM (
        SELECT doc_id::VARCHAR AS thread_id, CASE m WHEN 0 THEN 'repair' ELSE 'no_repair' END AS mode, 's' || k AS strategy,
          round((doc_id % 11) / 10.0::DOUBLE, 6) AS initial, round(((coalesce(n_chars, 0) * k + m * 31) % 997) / 997.0::DOUBLE, 6) AS final
        FROM documents, (SELECT unnest([1, 2, 3, 4]) AS k), (SELECT unnest([0, 1]) AS m)))""",
    "truth": "SELECT doc_id::VARCHAR AS thread_id, quality = 1 AS is_delta FROM labels",
    "swept": f"SELECT *, abs_delta >= threshold AS predicted FROM shifts, (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold)",
    "voted": """SELECT thread_id, mode, threshold, count(*) FILTER (predicted) AS votes_persuasive, count(*) AS votes_total, avg(abs_delta) AS mean_abs_delta,
        count(*) FILTER (predicted) >= ceil(count(*) / 2) AS predicted FROM swept GROUP BY ALL""",
    "ensembled": """SELECT thread_id, mode, threshold, strategy, abs_delta, predicted FROM swept
        UNION ALL SELECT thread_id, mode, threshold, 'ensemble', mean_abs_delta, predicted FROM voted""",
}


def metrics(source: str, by: str) -> str:
    return f"""SELECT {by}, n, tp, tn, fp, fn, round((tp + tn) / n, 4) AS accuracy,
        round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 4) AS recall,
        round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1,
        round(CASE WHEN u > 0 THEN (tp * tn - fp * fn)::DOUBLE / u ELSE 0.0 END, 4) AS mcc
      FROM (SELECT *, sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) AS u FROM (
        SELECT {by}, count(*) AS n, count(*) FILTER (predicted AND is_delta) AS tp, count(*) FILTER (NOT predicted AND NOT is_delta) AS tn,
          count(*) FILTER (predicted AND NOT is_delta) AS fp, count(*) FILTER (NOT predicted AND is_delta) AS fn
        FROM {source} JOIN truth USING (thread_id) WHERE is_delta IS NOT NULL GROUP BY ALL))"""


def auc(source: str, by: str) -> str:
    return f"""SELECT {by}, round(CASE WHEN p > 0 AND n > p THEN (r - p * (p + 1) / 2) / (p * (n - p)) END, 4) AS auc FROM (
        SELECT {by}, sum(mid) FILTER (is_delta) AS r, count(*) FILTER (is_delta) AS p, count(*) AS n FROM (
          SELECT {by}, is_delta, rank() OVER (PARTITION BY {by} ORDER BY abs_delta) + (count(*) OVER (PARTITION BY {by}, abs_delta) - 1) / 2 AS mid
          FROM {source} JOIN truth USING (thread_id) WHERE is_delta IS NOT NULL) GROUP BY ALL)"""


CHAIN |= {
    "at3": "SELECT *, abs_delta >= 0.3 AS predicted FROM shifts",
    "m3": metrics("at3", "mode, strategy"),
    "m_all": metrics("ensembled", "mode, threshold, strategy"),
    "fine": "SELECT *, abs_delta >= threshold AS predicted FROM shifts, (SELECT round(unnest(range(1, 51)) * 0.01, 2)::DOUBLE AS threshold)",
    "m_fine": metrics("fine", "mode, strategy, threshold"),
    "first": f"SELECT * FROM ensembled WHERE threshold = {min(THRESHOLDS)}",
    "auc_all": auc("first", "mode, strategy"),
    "evaluated": "SELECT mode, threshold, strategy, n, accuracy, f1, auc FROM m_all LEFT JOIN auc_all USING (mode, strategy)",
    "stats": """SELECT n.thread_id, n.mode, n.n_units, n.n_speakers, coalesce(e.s, 0) AS n_support, coalesce(e.a, 0) AS n_attack, coalesce(e.r, 0) AS n_atk_root,
        coalesce(e.s, 0) || ':' || greatest(coalesce(e.a, 0), 1) AS ratio
        FROM (SELECT thread_id, mode, count(*) AS n_units, count(DISTINCT nullif(speaker_id, '')) AS n_speakers FROM both_nodes GROUP BY ALL) n LEFT JOIN (
          SELECT thread_id, mode, count(*) FILTER (relation = 'support') AS s, count(*) FILTER (relation = 'attack') AS a, count(*) FILTER (relation = 'attack' AND target_idx = root_idx) AS r
          FROM turned JOIN roots USING (thread_id) GROUP BY ALL) e ON e.thread_id = n.thread_id AND e.mode = n.mode""",
    "direct": "SELECT e.*, 0 AS level FROM turned e JOIN roots USING (thread_id) WHERE target_idx = root_idx",
    "indirect": """SELECT e.*, 1 AS level FROM turned e WHERE relation = 'attack'
        AND (thread_id, mode, target_idx) IN (SELECT thread_id, mode, source_idx FROM direct WHERE relation = 'support')
        AND (thread_id, mode, source_idx) NOT IN (SELECT thread_id, mode, source_idx FROM direct WHERE relation = 'attack')""",
    "verdicts": "SELECT DISTINCT thread_id, mode, thread_id::BIGINT % 3 = 0 AS predicted, CASE WHEN thread_id::BIGINT % 5 <> 0 THEN is_delta END AS ground_truth FROM both_nodes JOIN threads USING (thread_id)",
}



def reason() -> str:
    """Why a vote was right or wrong, from stats and a verdict."""
    return """CASE WHEN ground_truth IS NULL THEN ''
          WHEN predicted AND ground_truth THEN 'Rightly persuaded: ' || n_attack || ' attacks moved the root far enough.'
          WHEN NOT predicted AND NOT ground_truth THEN 'Rightly unmoved: ' || n_support || ' supports held the root against ' || n_attack || ' attacks.'
          WHEN predicted THEN 'Wrongly persuaded: ' || n_attack || ' attacks, ' || n_atk_root || ' of them on the root, look like a change of view.'
          ELSE 'Wrongly unmoved: ' || n_support || ' supports hid a change of view behind ' || n_attack || ' attacks.' END"""


CHAIN |= {
    "arguments": """SELECT thread_id, mode, relation, place, level, source_idx FROM (
        SELECT *, row_number() OVER (PARTITION BY thread_id, mode, relation ORDER BY level, source_idx, target_idx) AS place FROM (SELECT * FROM direct UNION ALL SELECT * FROM indirect)) WHERE place <= 3""",
    "written": f"""SELECT n.thread_id, n.mode, '# Thread ' || n.thread_id || ' (' || n.mode || ')' || chr(10) || chr(10) || '> ' || n.text || chr(10) || chr(10)
          || n_units || ' units, ' || n_speakers || ' speakers, ' || n_support || ' supports, ' || n_attack || ' attacks (' || n_atk_root || ' on the root)' || chr(10) || chr(10) || '## Key arguments' || chr(10) || coalesce(a.l, '(none)')
          || chr(10) || chr(10) || '## Strategies' || chr(10) || '| strategy | initial | final | shift |' || chr(10) || '|-|-|-|-|' || chr(10) || t.l || chr(10) || chr(10) || '## Thresholds' || chr(10) || '| threshold | votes | persuaded |' || chr(10) || '|-|-|-|' || chr(10) || v.l
          || chr(10) || chr(10) || v.shown || chr(10) || chr(10) || {reason()} || chr(10) AS page
        FROM both_nodes n JOIN stats USING (thread_id, mode)
        LEFT JOIN (SELECT g.thread_id, g.mode, string_agg('- ' || relation || ': ' || text, chr(10) ORDER BY relation, place) AS l FROM arguments g JOIN both_nodes s ON s.thread_id = g.thread_id AND s.mode = g.mode AND s.global_idx = g.source_idx GROUP BY ALL) a USING (thread_id, mode)
        JOIN (SELECT thread_id, mode, string_agg(printf('| %s | %.6f | %.6f | %.6f |', strategy, initial, final, delta), chr(10) ORDER BY strategy) AS l FROM root_shifts GROUP BY ALL) t USING (thread_id, mode)
        JOIN (SELECT thread_id, mode, bool_or(predicted) FILTER (threshold = 0.1) AS predicted, string_agg(printf('| %.2f | %d of %d | %s |', threshold, votes, total, CASE WHEN predicted THEN 'yes' ELSE 'no' END), chr(10) ORDER BY threshold) AS l,
            max('At 0.30: ' || CASE WHEN predicted THEN 'persuaded' ELSE 'not persuaded' END || '.') FILTER (threshold = 0.3) AS shown FROM root_votes GROUP BY ALL) v USING (thread_id, mode)
        JOIN (SELECT thread_id, is_delta AS ground_truth FROM threads) h USING (thread_id) WHERE n.is_root""",
}

FINAL: dict[str, str] = {
    "jsonl_scan": "SELECT thread_id, count(*) AS turns FROM posts GROUP BY ALL",
    "resume_anti_join": "SELECT doc_id::VARCHAR AS thread_id FROM documents WHERE NOT (doc_id % 3 = 0 AND n_chars IS NOT NULL)",
    "prefilter_anti_join": """SELECT doc_id, thread_id, id FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN doc_id::VARCHAR END AS thread_id, CASE WHEN doc_id % 7 <> 0 THEN doc_id::VARCHAR END AS id FROM documents)
        WHERE coalesce(thread_id, id) IS NULL OR coalesce(thread_id, id) NOT IN (SELECT item_id::VARCHAR FROM benchmark)""",
    "range_slice": "SELECT row_number() OVER (ORDER BY doc_id) AS line, doc_id::VARCHAR AS thread_id FROM documents QUALIFY line BETWEEN 11 AND 60",
    "round_robin_shard": "SELECT k % 2 AS shard, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k FROM documents) GROUP BY ALL",
    "index_by_thread": """SELECT thread_id, conv_id, line, role FROM (SELECT CASE WHEN conv_id % 3 <> 0 THEN conv_id::VARCHAR END AS thread_id, CASE WHEN conv_id % 5 <> 0 THEN conv_id::VARCHAR END AS conv_id, conv_id * 1000 + turn AS line, role FROM conversations)
        QUALIFY row_number() OVER (PARTITION BY coalesce(thread_id, conv_id, 'row_' || line) ORDER BY line DESC) = 1""",
    "load_predictions": "SELECT doc_id::VARCHAR AS thread_id, coalesce(CASE WHEN doc_id % 4 <> 0 THEN quality = 1 END, toxic = 1) AS ground_truth FROM labels WHERE doc_id % 10 <> 9",
    "count_lines": "SELECT count(*) AS lines FROM documents",
    "load_ground_truth": "SELECT doc_id::VARCHAR AS thread_id, (quality = 1) <> (doc_id % 3 = 0) AS label FROM labels WHERE quality IS NOT NULL",
    "inject_ground_truth": "SELECT d.doc_id::VARCHAR AS thread_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN true END, l.quality = 1) AS ground_truth FROM documents d LEFT JOIN labels l USING (doc_id)",
    "clean_turns": "SELECT thread_id, turn_pos, text FROM turns",
    "clean_documents": f"SELECT doc_id AS thread_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {clean('coalesce(text, chr(32))')} AS t FROM documents)",
    "turn_batches": "SELECT thread_id, turn_pos, batch FROM packed",
    "batch_prompts": "SELECT thread_id, batch, prompt FROM prompts",
    "parse_edu_json": f"""SELECT thread_id, turn_pos, unnest(e) AS edu, (generate_subscripts(e, 1) - 1)::INT AS pos FROM (
        SELECT thread_id, turn_pos, CASE WHEN turn_pos % 4 IN (0, 1) THEN list_filter([{strip('text')}, 'second unit of it'], lambda x: x <> '')
          WHEN turn_pos % 4 = 2 THEN list_filter([{strip('text')}], lambda x: x <> '') ELSE {segments('text')} END AS e FROM turns)""",
    "fallback_edus": "SELECT thread_id, turn_pos, pos, edu FROM raw_edus",
    "document_edus": f"SELECT thread_id, count(*) AS n, sum(length(edu))::BIGINT AS chars, max(edu) AS last FROM (SELECT doc_id AS thread_id, unnest({segments('text')}) AS edu FROM documents) GROUP BY ALL",
    "edu_attribution": f"""SELECT thread_id, batch, pos, turn_pos FROM (SELECT thread_id, batch, unnest(e) AS edu, generate_subscripts(e, 1) - 1 AS pos FROM (SELECT *, {segments('prompt')} AS e FROM prompts))
        JOIN packed p USING (thread_id, batch) QUALIFY row_number() OVER (PARTITION BY thread_id, batch, pos ORDER BY contains(lower(p.text), lower(edu)) DESC,
          CASE WHEN contains(lower(p.text), lower(edu)) THEN 0 ELSE {overlap('edu', 'p.text')} END DESC, turn_pos) = 1""",
    "edu_dedup": """SELECT thread_id, turn_pos, pos, edu FROM (SELECT thread_id, turn_pos, pos, edu FROM raw_edus UNION ALL SELECT thread_id, turn_pos, pos + 1000, translate(edu, 'abcdefghij', 'ABCDEFGHIJ') FROM raw_edus)
        QUALIFY row_number() OVER (PARTITION BY thread_id, turn_pos, lower(edu) ORDER BY pos) = 1""",
    "edu_filter": f"SELECT thread_id, turn_pos, pos, edu FROM raw_edus WHERE NOT regexp_matches(edu, '{PROFILE.deleted_regex}') AND len({tokens('edu')}) > 4",
    "edu_summary": "SELECT thread_id, count(*) AS total_turns, (SELECT count(*) FROM edus e WHERE e.thread_id = t.thread_id) AS total_edus FROM turns t GROUP BY ALL",
    "transcript_turns": """SELECT thread_id || '_1' AS thread_id, '' || 'Misure sul fiume' AS title, 3 AS turn_count, sum(len(regexp_extract_all(said, '[.!?]+'))) OVER (PARTITION BY thread_id)::BIGINT AS sentence_count,
        thread_id || '_t' || k AS post_id, CASE WHEN k = 1 THEN '' ELSE thread_id || '_t' || (k - 1) END AS parent_id, 'Speaker ' || CASE k WHEN 2 THEN 2 ELSE 1 END AS speaker_id, ['question', 'response', 'counter-reply'][k] AS role,
        CASE who WHEN 0 THEN 'Anna D''Arco' WHEN 1 THEN 'Mario Rossi' ELSE 'Ugo De Ré' END AS speaker_name, CASE who WHEN 0 THEN 'M5S-X' WHEN 1 THEN 'Ministro dell’interno' ELSE 'PD' END AS affiliation, md5(said) AS digest FROM interro_posts""",
    "model_edus": f"""SELECT thread_id, turn_pos, row_number() OVER (PARTITION BY thread_id, turn_pos ORDER BY batch, pos) - 1 AS local_idx, text
        FROM model_once WHERE NOT regexp_matches(text, '{PROFILE.deleted_regex}') AND len({tokens('text')}) > {PROFILE.min_words}""",
    "model_central": """SELECT thread_id, CASE WHEN thread_id::INT % 5 < 4 AND thread_id::INT % 5 < len(units) THEN units[thread_id::INT % 5 + 1] ELSE central_proposition END AS central_proposition,
        CASE WHEN thread_id::INT % 5 < 4 AND thread_id::INT % 5 < len(units) THEN 'model' ELSE method END AS method FROM central LEFT JOIN opening USING (thread_id)""",
    "prompt_text": f"SELECT batch_id, string_agg({asked()}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS prompt FROM items GROUP BY ALL",
    "tiebreak_prompt": f"""SELECT batch_id, '{WHY["disagreement"]}' || chr(10) || chr(10) || string_agg({asked('place')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS prompt FROM (
        SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS place FROM items WHERE (batch_id, global_idx) IN (SELECT batch_id, target_idx FROM calls WHERE call1 <> call2)) GROUP BY ALL""",
    "model_relations": """SELECT p.thread_id, p.target_idx, p.source_idx, coalesce(r, 'neutral') AS relation, CASE WHEN r IS NULL THEN 'gave_up' ELSE m END AS method
        FROM pacs p JOIN ruled u ON u.batch_id = p.thread_id || '_' || (p.target_idx // 10) AND u.target_idx = p.target_idx AND u.source_idx = p.pac_pos""",
    "cp_review_applied": """SELECT c.thread_id, c.target_idx, c.source_idx, CASE WHEN v.thread_id IS NOT NULL THEN CASE WHEN pac_pos = 0 THEN 'attack' ELSE 'neutral' END ELSE c.relation END AS relation, v.thread_id IS NOT NULL AS cp_review_applied
        FROM calm c LEFT JOIN reviewed v ON v.thread_id = c.thread_id AND v.target_idx = c.target_idx AND v.thread_id::INT % 2 = 0""",
    "pagerank": "SELECT thread_id, mode, global_idx, round(pagerank, 6) AS pagerank FROM ranks",
    "strength_sei": "SELECT thread_id, mode, global_idx, s2 FROM s2s",
    "context_embed": "SELECT thread_id, mode, global_idx, term, round(w, 6) AS w FROM cvecs",
    "strength_csi": "SELECT thread_id, mode, global_idx, s3 FROM s3s",
    "strength_hi": "SELECT thread_id, mode, global_idx, s4 FROM s4s",
    "gradual_fixpoint": "SELECT thread_id, mode, strategy, global_idx, initial_strength, acceptability FROM ends",
    "detect_strategies": "SELECT strategy, count(*) AS graphs FROM (SELECT DISTINCT thread_id, mode, strategy FROM starts) GROUP BY ALL",
    "semantics_meta": f"SELECT thread_id, mode, strategy, t AS iterations, delta < {PROFILE.eps} AS converged, round(delta, 9) AS delta_final FROM settled",
    "root_shift": "SELECT * FROM root_shifts",
    "central_prop_overlap": "SELECT thread_id, central_proposition, method FROM central",
    "edu_index": "SELECT thread_id, global_idx, turn_pos, local_idx, is_central_prop, text FROM idx",
    "reply_children": "SELECT DISTINCT thread_id, parent_id, post_id FROM posts WHERE parent_id <> ''",
    "pac_candidates": "SELECT thread_id, target_idx, source_idx, pac_scope FROM pairs",
    "pairwise_cosine": "SELECT thread_id, target_idx, source_idx, round(sim, 6) AS sim FROM pairs",
    "dense_cosine_topk": """SELECT a AS target_idx, b AS source_idx, round(sim, 5) AS sim, k - 1 AS pac_pos FROM (
        SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) AS sim,
          row_number() OVER (PARTITION BY x.vec_id ORDER BY list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) DESC, y.vec_id) AS k
        FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id) WHERE sim >= 0.15 AND k <= 3""",
    "implicit_targets": f"SELECT thread_id, target_idx, round(best, 6) AS best, best < {T} AS implicit FROM best",
    "pac_implicit": "SELECT thread_id, target_idx, source_idx, pac_pos FROM implicit",
    "pac_topk": "SELECT thread_id, target_idx, source_idx, pac_scope, pac_pos, round(sim, 6) AS sim FROM semantic",
    "pac_summary": """SELECT thread_id, count(*) AS total_edus, sum(n)::BIGINT AS total_pacs, round(sum(n) / count(*), 2) AS avg_pacs, min(n) AS min_pacs, max(n) AS max_pacs FROM (
        SELECT i.thread_id, i.global_idx, count(p.source_idx) AS n FROM idx i LEFT JOIN pacs p ON p.thread_id = i.thread_id AND p.target_idx = i.global_idx GROUP BY ALL) GROUP BY ALL""",
    "pac_sim_percentiles": "SELECT pac_scope, n, round(imp / n, 4) AS implicit_share, "
    + ", ".join(f"s[floor({q} * (n - 1))::BIGINT + 1] AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    + " FROM (SELECT pac_scope, count(*) AS n, count(*) FILTER (selection_type = 'IMPLICIT') AS imp, list_sort(list(cosine_sim)) AS s FROM pacs GROUP BY ALL)",
    "context_window": """SELECT thread_id, global_idx, coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(text, ' | ') OVER (w ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM idx WINDOW w AS (PARTITION BY thread_id, post_id ORDER BY local_idx)""",
    "edu_batches": "SELECT thread_id, global_idx, global_idx // 10 AS batch, global_idx % 10 AS batch_pos FROM idx",
    "confidence_gate": f"""SELECT thread_id, target_idx, source_idx, CASE WHEN relation = 'support' AND cosine_sim <= {PROFILE.support_gate} OR relation = 'attack' AND cosine_sim <= {PROFILE.attack_gate}
        THEN 'neutral' ELSE relation END AS relation FROM relations""",
    "parse_relations": f"""SELECT e.batch_id, e.target_idx, e.source_idx, CASE WHEN e.source_idx = 3 THEN 'neutral' WHEN e.source_idx % 3 = 2 THEN v.relation
          WHEN v.relation = 'support' AND (40 + (e.source_idx % 3) * 10) / 100 <= {PROFILE.support_gate} OR v.relation = 'attack' AND (40 + (e.source_idx % 3) * 10) / 100 <= {PROFILE.attack_gate} THEN 'neutral'
          ELSE v.relation END AS relation
        FROM expected e JOIN votes v ON v.batch_id = e.batch_id AND v.target_idx = e.target_idx AND v.source_idx = e.source_idx AND call_no = 1
        WHERE (e.batch_id, e.target_idx) IN (SELECT batch_id, target_idx FROM expected WHERE source_idx <> 3)""",
    "disputed_pairs": "SELECT batch_id, target_idx, source_idx, call1, call2 FROM calls WHERE call1 <> call2",
    "self_consistency_merge": """SELECT batch_id, target_idx, source_idx, coalesce(r, 'neutral') AS relation,
          CASE WHEN r IS NULL THEN 'missing' WHEN NOT h1 AND NOT h2 THEN 'third' WHEN NOT h1 OR NOT h2 THEN 'single' WHEN r1 <> r2 AND r3 IS NOT NULL THEN 'tiebreak' WHEN r1 <> r2 THEN 'call1' ELSE 'agreed' END AS method
        FROM (SELECT *, CASE WHEN NOT h1 AND NOT h2 THEN r3 WHEN NOT h1 THEN r2 WHEN r1 <> r2 THEN coalesce(r3, r1) ELSE r1 END AS r FROM (
          SELECT *, coalesce(bool_or(r1 IS NOT NULL) OVER (PARTITION BY batch_id), false) AS h1, coalesce(bool_or(r2 IS NOT NULL) OVER (PARTITION BY batch_id), false) AS h2 FROM (
            SELECT batch_id, target_idx, source_idx, CASE WHEN length(batch_id) % 4 <> 1 AND target_idx % 6 <> 5 THEN call1 END AS r1,
              CASE WHEN length(batch_id) % 4 <> 2 THEN call2 END AS r2, CASE WHEN target_idx % 4 <> 3 THEN call3 END AS r3 FROM calls)))""",
    "tiebreak_audit": "SELECT batch_id, target_idx, source_idx, 'tiebreak' AS method, call1, call2, call3 AS resolved FROM calls WHERE call1 <> call2",
    "majority_vote": """SELECT batch_id, target_idx, source_idx, relation, n AS votes FROM (SELECT batch_id, target_idx, source_idx, relation, count(*) AS n, min(call_no) AS f FROM votes GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY batch_id, target_idx, source_idx ORDER BY n DESC, f) = 1""",
    "argumentative_edus": "SELECT *, support + attack > 0 AS target_is_argumentative FROM counted",
    "reasoning_summary": """SELECT i.thread_id, count(*) AS total_edus, count(*) FILTER (support + attack > 0) AS argumentative_edus, count(*) FILTER (support IS NULL) AS skipped_edus,
        coalesce(sum(support), 0)::BIGINT AS support_relations, coalesce(sum(attack), 0)::BIGINT AS attack_relations, coalesce(sum(neutral), 0)::BIGINT AS neutral_relations
        FROM idx i LEFT JOIN counted c ON c.thread_id = i.thread_id AND c.target_idx = i.global_idx GROUP BY ALL""",
    "cp_review_candidates": """SELECT c.thread_id, target_idx, neutral FROM counted c JOIN (SELECT thread_id, min(global_idx) AS target_idx FROM idx WHERE is_central_prop GROUP BY ALL) USING (thread_id, target_idx)
        WHERE support + attack = 0""",
    "canonical_edges": "SELECT thread_id, source_idx, target_idx, relation FROM edges",
    "bas_nodes": "SELECT thread_id, global_idx, 'edu_' || global_idx AS id, speaker_id, is_central_prop FROM nodes",
    "degrees": """SELECT thread_id, global_idx, (SELECT count(*) FROM edges e WHERE e.thread_id = n.thread_id AND e.target_idx = n.global_idx) AS in_degree,
        (SELECT count(*) FROM edges e WHERE e.thread_id = n.thread_id AND e.source_idx = n.global_idx) AS out_degree FROM nodes n""",
    "root_node": "SELECT thread_id, root_idx FROM roots",
    "components": "SELECT thread_id, global_idx, component, size, rank FROM comps",
    "repair_edges": "SELECT thread_id, source_idx, target_idx, relation FROM repairs",
    "central_subgraph": "SELECT thread_id, global_idx FROM main",
    "min_units_filter": "SELECT thread_id, units FROM large",
    "bas_edges": "SELECT thread_id, mode, source_idx, target_idx, relation, synthetic FROM both_edges",
    "bas_summary": """SELECT n.thread_id, n.mode, total_nodes, coalesce(te, 0) AS total_edges, coalesce(se, 0) AS support_edges, coalesce(ae, 0) AS attack_edges, coalesce(sy, 0) AS synthetic_edges, root_id, root_text, speaker_breakdown
        FROM (SELECT thread_id, mode, count(*) AS total_nodes, max('edu_' || global_idx) FILTER (is_root) AS root_id, max(text) FILTER (is_root) AS root_text FROM both_nodes GROUP BY ALL) n
        JOIN (SELECT thread_id, mode, string_agg(speaker_id || '=' || c, ',' ORDER BY speaker_id) AS speaker_breakdown FROM (SELECT thread_id, mode, speaker_id, count(*) AS c FROM both_nodes GROUP BY ALL) GROUP BY ALL) s USING (thread_id, mode)
        LEFT JOIN (SELECT thread_id, mode, count(*) AS te, count(*) FILTER (relation = 'support') AS se, count(*) FILTER (relation = 'attack') AS ae, count(*) FILTER (synthetic) AS sy FROM both_edges GROUP BY ALL) e USING (thread_id, mode)""",
    "dot_export": """SELECT n.thread_id, n.mode, 'digraph bas {' || chr(10) || n.l || chr(10) || coalesce(e.l || chr(10), '') || '}' AS dot
        FROM (SELECT thread_id, mode, string_agg('  "edu_' || global_idx || '" [label="' || replace('[' || speaker_id || '] ' || left(text, 35) || CASE WHEN length(text) > 35 THEN '…' ELSE '' END, '"', '''')
            || '", shape=' || CASE WHEN is_root THEN 'doublecircle' ELSE 'ellipse' END || '];', chr(10) ORDER BY global_idx) AS l FROM both_nodes GROUP BY ALL) n
        LEFT JOIN (SELECT thread_id, mode, string_agg('  "edu_' || source_idx || '" -> "edu_' || target_idx || '" [color=' || CASE relation WHEN 'support' THEN 'green4' ELSE 'red3' END
            || CASE WHEN synthetic THEN ', style=dashed' ELSE '' END || '];', chr(10) ORDER BY source_idx, target_idx) AS l FROM both_edges GROUP BY ALL) e USING (thread_id, mode)""",
    "token_entropy": "SELECT thread_id, global_idx, round(entropy, 6) AS entropy FROM entropies",
    "explicitness": "SELECT thread_id, mode, global_idx, round(explicitness, 6) AS explicitness FROM explicit",
    "minmax_norm": """SELECT thread_id, mode, global_idx, round(CASE WHEN abs(hi - lo) <= 1e-9 * greatest(abs(hi), abs(lo)) THEN 1.0 ELSE (x - lo) / (hi - lo) END, 6) AS x FROM (
        SELECT thread_id, mode, global_idx, (in_degree * 2 + out_degree)::DOUBLE AS x, min(in_degree * 2 + out_degree) OVER g AS lo, max(in_degree * 2 + out_degree) OVER g AS hi FROM both_degrees WINDOW g AS (PARTITION BY thread_id, mode))""",
    "strength_ui": "SELECT thread_id, mode, global_idx, 1.0::DOUBLE AS s1 FROM both_nodes",
    "ancestor_depths": "SELECT thread_id, mode, global_idx, ancestor, min(depth)::BIGINT AS depth FROM ancestors WHERE ancestor <> global_idx GROUP BY ALL",
    "expansion_node": "SELECT * FROM expanded",
    "root_reversal": "SELECT thread_id, mode, source_idx, target_idx, relation, synthetic FROM turned",
    "edge_weights": "SELECT thread_id, mode, source_idx, target_idx, relation, round(weight, 6) AS weight FROM weighted",
    "softmax_agg": "SELECT thread_id, mode, global_idx, round(s, 6) AS s FROM round1",
    "gradual_t5": "SELECT thread_id, mode, global_idx, round(s, 6) AS s FROM round5",
    "root_deltas": "SELECT thread_id, mode, strategy, initial, final, delta, abs_delta FROM shifts",
    "predict_threshold": "SELECT thread_id, mode, strategy, predicted, is_delta AS ground_truth, predicted = is_delta AS correct FROM at3 LEFT JOIN truth USING (thread_id)",
    "threshold_sweep": "SELECT mode, strategy, threshold, count(*) FILTER (abs_delta >= threshold) AS positives FROM shifts, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold) GROUP BY ALL",
    "ensemble_vote": "SELECT thread_id, mode, threshold, votes_persuasive, votes_total, predicted FROM voted",
    "binary_metrics": "SELECT * FROM m3",
    "dataset_metrics": "SELECT * FROM m_all",
    "tune_threshold": "SELECT mode, strategy, threshold AS best_threshold, f1 AS best FROM m_fine QUALIFY row_number() OVER (PARTITION BY mode, strategy ORDER BY f1 DESC, threshold) = 1",
    "accuracy": "SELECT mode, strategy, accuracy FROM m3",
    "f1": "SELECT mode, strategy, f1 FROM m3",
    "auc_roc": auc("shifts", "mode, strategy"),
    "evaluate": "SELECT * FROM evaluated",
    "metric_pivot": "SELECT mode, threshold, " + ", ".join(f"max(f1) FILTER (strategy = '{s}') AS {s}" for s in ("s1", "s2", "s3", "s4", "ensemble")) + " FROM evaluated GROUP BY ALL",
    "mode_comparison": "SELECT threshold, strategy, a.f1 AS repair, b.f1 AS no_repair, round(a.f1 - b.f1, 4) AS difference FROM evaluated a JOIN evaluated b USING (threshold, strategy) WHERE a.mode = 'repair' AND b.mode = 'no_repair'",
    "prediction_records": """SELECT thread_id, mode, is_delta AS ground_truth, threshold::VARCHAR AS threshold, votes >= ceil(n / 2) AS ensemble, (votes >= ceil(n / 2)) = is_delta AS correct, s2, s2_delta FROM (
        SELECT thread_id, mode, threshold, count(*) FILTER (abs_delta >= threshold) AS votes, count(*) AS n, bool_or(abs_delta >= threshold) FILTER (strategy = 's2') AS s2, max(delta) FILTER (strategy = 's2') AS s2_delta
        FROM shifts, (SELECT unnest([0.1, 0.3])::DOUBLE AS threshold) GROUP BY ALL) LEFT JOIN truth USING (thread_id)""",
    "metrics_json": "SELECT mode, threshold, strategy, n, accuracy, f1, auc FROM evaluated",
    "step_records": """SELECT t.thread_id, t.turns, i.skipped, coalesce(p.pairs, 0) AS pairs, coalesce(p.attacks, 0) AS attacks, coalesce(p.places, 0)::BIGINT AS places, coalesce(i.units, 0) AS units, coalesce(i.chars, 0)::BIGINT AS chars
        FROM (SELECT thread_id, count(*) AS turns FROM turns GROUP BY ALL) t
        LEFT JOIN (SELECT i.thread_id, count(*) AS units, sum(length(text)) AS chars, count(*) FILTER (c.support IS NULL) AS skipped FROM idx i LEFT JOIN counted c ON c.thread_id = i.thread_id AND c.target_idx = i.global_idx GROUP BY ALL) i USING (thread_id)
        LEFT JOIN (SELECT thread_id, count(*) AS pairs, count(*) FILTER (relation = 'attack') AS attacks, sum(pac_pos) AS places FROM relations GROUP BY ALL) p USING (thread_id)""",
    "graph_stats": "SELECT * FROM stats",
    "key_arguments": "SELECT thread_id, mode, relation, place, level, source_idx FROM arguments",
    "report_md": "SELECT thread_id, mode, page FROM written",
    "report_pdf": "SELECT mode, count(*) AS files, true AS begins, '%%EOF' AS ends FROM written GROUP BY ALL",
    "failure_reason": f"SELECT thread_id, mode, predicted, ground_truth, {reason()} AS reason FROM stats JOIN verdicts USING (thread_id, mode)",
    "report_join": "SELECT thread_id, mode FROM verdicts WHERE predicted",
}


def _needed(final: str) -> list[str]:
    wanted, todo = set(), [final]
    while todo:
        text = todo.pop()
        for name in CHAIN:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(CHAIN[name])
    return [n for n in CHAIN if n in wanted]


def _whole(final: str) -> str:
    recursive = {n for n in CHAIN if re.search(rf"\b(?:FROM|JOIN) {n}\b", CHAIN[n])}
    parts = ",\n".join(f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({CHAIN[n]})" for n in _needed(final))
    return f"WITH RECURSIVE {parts}\n{final}" if parts else final


SQL = {k: _whole(v) for k, v in FINAL.items()}
