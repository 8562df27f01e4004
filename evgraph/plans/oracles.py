"""The same corpora and operators in DuckDB SQL, as common table expressions by name."""

from __future__ import annotations

import re


def _index(x: str) -> dict[str, str]:
    """Inverted index and sparse join over the corpus x."""
    return {
        f"{x}_freq": f"SELECT video_id, word, count(*) AS n_z FROM {x}_words GROUP BY ALL",
        f"{x}_n": f"SELECT video_id, count(*) AS n FROM {x}_events GROUP BY ALL",
        f"{x}_weights": f"SELECT video_id, word, n_z, ln(n / n_z) AS gamma FROM {x}_freq JOIN {x}_n USING (video_id) WHERE n_z <= 50",
        f"{x}_norms": f"SELECT e.video_id, e.event_idx, CASE WHEN coalesce(s.q, 0) > 0 THEN sqrt(s.q) ELSE 1.0 END AS norm FROM {x}_events e LEFT JOIN (SELECT video_id, event_idx, sum(gamma * gamma) AS q FROM {x}_words JOIN {x}_weights USING (video_id, word) GROUP BY ALL) s USING (video_id, event_idx)",
        f"{x}_share": f"SELECT video_id, word, event_idx, gamma / norm AS share FROM {x}_words JOIN {x}_weights USING (video_id, word) JOIN {x}_norms USING (video_id, event_idx) WHERE n_z >= 2 AND gamma <> 0",
        f"{x}_sim": f"SELECT a.video_id, a.event_idx AS src, b.event_idx AS dst, sum(a.share * b.share) AS sim FROM {x}_share a JOIN {x}_share b ON a.video_id = b.video_id AND a.word = b.word AND a.event_idx + 2 <= b.event_idx GROUP BY ALL",
    }


_UNIT = "list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"

CTES: dict[str, str] = {
    # D
    "d_events": "SELECT source AS video_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS event_idx, text FROM documents",
    "d_words": "SELECT DISTINCT video_id, word, event_idx FROM (SELECT video_id, event_idx, unnest(string_split_regex(lower(text), '[^a-zà-ÿ]+')) AS word FROM d_events) WHERE word <> ''",
    **_index("d"),
    # V
    "v_ranked": "SELECT vec_id, label AS video_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS rk FROM embeddings",
    "v_frames": "SELECT video_id, rk // 4 AS event_idx, rk % 4 AS frame_no, vec FROM v_ranked",
    "v_events": "SELECT DISTINCT video_id, event_idx FROM v_frames",
    "v_patches": f"SELECT video_id, event_idx, frame_no, patch_no, {_UNIT.format(v='p')} AS u FROM (SELECT video_id, event_idx, frame_no, CAST(k AS INTEGER) AS patch_no, vec[k * 8 + 1 : k * 8 + 8] AS p FROM v_frames, (SELECT unnest(range(8)) AS k))",
    "v_codebook": "SELECT video_id, word_id, u AS centroid FROM (SELECT *, CAST(row_number() OVER (PARTITION BY video_id ORDER BY event_idx, frame_no, patch_no) - 1 AS INTEGER) AS word_id FROM v_patches) WHERE word_id < 64",
    "v_quant": "SELECT video_id, event_idx, frame_no, patch_no, word_id, u FROM v_patches JOIN v_codebook USING (video_id) QUALIFY row_number() OVER (PARTITION BY video_id, event_idx, frame_no, patch_no ORDER BY round(list_dot_product(u, centroid), 9) DESC, word_id) = 1",
    "v_words": "SELECT DISTINCT video_id, event_idx, word_id AS word FROM v_quant",
    "v_unit": f"SELECT video_id, event_idx, {_UNIT.format(v='vec')} AS u FROM v_frames",
    "v_dims": "SELECT video_id, event_idx, CAST(d AS INTEGER) AS dim, avg(u[d + 1]) AS x FROM v_unit, (SELECT unnest(range(64)) AS d) GROUP BY ALL",
    "v_g": "SELECT video_id, event_idx, list(x ORDER BY dim) AS g FROM v_dims GROUP BY ALL",
    "v_gu": f"SELECT video_id, event_idx, {_UNIT.format(v='g')} AS u FROM v_g",
    **_index("v"),
    "v_cos": "SELECT s.video_id, s.src, s.dst, s.sim, list_dot_product(a.u, b.u) AS cos FROM v_sim s JOIN v_gu a ON a.video_id = s.video_id AND a.event_idx = s.src JOIN v_gu b ON b.video_id = s.video_id AND b.event_idx = s.dst",
    "v_sem": "SELECT video_id, src, dst, (sim + cos) / 2 AS weight FROM v_cos WHERE round((sim + cos) / 2, 9) >= 0.25",
    "v_best": "SELECT a.video_id, a.event_idx AS src, b.event_idx AS dst, a.frame_no, a.patch_no, greatest(-1, max(list_dot_product(a.u, b.u))) AS m FROM v_patches a JOIN v_patches b ON a.video_id = b.video_id AND a.event_idx + 2 <= b.event_idx GROUP BY ALL",
    "v_dense": "SELECT s.video_id, s.src, s.dst, (s.sim + list_dot_product(a.u, b.u)) / 2 AS weight FROM (SELECT video_id, src, dst, avg(m) AS sim FROM v_best GROUP BY ALL) s JOIN v_gu a ON a.video_id = s.video_id AND a.event_idx = s.src JOIN v_gu b ON b.video_id = s.video_id AND b.event_idx = s.dst",
    "v_temporal": "SELECT a.video_id, a.event_idx AS src, b.event_idx AS dst, 1.0::DOUBLE AS weight FROM v_events a JOIN v_events b ON a.video_id = b.video_id AND b.event_idx = a.event_idx + 1",
    "v_adj": "SELECT * FROM v_temporal UNION ALL SELECT video_id, src, dst, weight FROM v_sem",
    "v_out": "SELECT * FROM v_adj UNION ALL SELECT video_id, event_idx, event_idx, 1.0 FROM v_events e WHERE NOT EXISTS (SELECT 1 FROM v_adj a WHERE a.video_id = e.video_id AND a.src = e.event_idx)",
    "v_trans": "SELECT video_id, src, dst, weight / sum(weight) OVER (PARTITION BY video_id, src) AS p FROM v_out",
    "v_walk": "SELECT video_id, event_idx AS src, event_idx AS dst, 1.0::DOUBLE AS x, 0 AS k FROM v_events UNION ALL SELECT w.video_id, w.src, t.dst, sum(0.85 * w.x * t.p), w.k + 1 FROM v_walk w JOIN v_trans t ON t.video_id = w.video_id AND t.src = w.dst WHERE w.k < 74 GROUP BY w.video_id, w.src, t.dst, w.k",
    "v_ppr": "SELECT video_id, src, dst, 0.15 * sum(x) AS pi FROM v_walk GROUP BY ALL",
    "v_pi": "SELECT a.video_id, a.event_idx AS src, list(coalesce(p.pi, 0.0) ORDER BY b.event_idx) AS pi FROM v_events a JOIN v_events b ON a.video_id = b.video_id LEFT JOIN v_ppr p ON p.video_id = a.video_id AND p.src = a.event_idx AND p.dst = b.event_idx GROUP BY ALL",
    "v_costs": "SELECT video_id, event_idx, count(*) AS n_frames, count(*) * 144.0::DOUBLE AS cost FROM v_frames GROUP BY ALL",
    "v_queries": f"SELECT vec_id AS query_id, (video_id + 1) % 10 AS video_id, {_UNIT.format(v='vec')} AS q FROM v_ranked",
    "v_rel": "SELECT query_id, video_id, event_idx, greatest(0.0, list_dot_product(q, u)) AS rel FROM v_queries JOIN v_gu USING (video_id)",
    "v_rels": "SELECT query_id, video_id, list(rel ORDER BY event_idx) AS rels FROM v_rel GROUP BY ALL",
    "v_greedy": """SELECT query_id, video_id, 0 AS pick_order, -1 AS event_idx, 0.0::DOUBLE AS spent, []::INTEGER[] AS taken, list_transform(rels, lambda x: 0.0::DOUBLE) AS r FROM v_rels UNION ALL
        SELECT query_id, video_id, pick_order, event_idx, spent, taken, r FROM (
            SELECT g.query_id, g.video_id, g.pick_order + 1 AS pick_order, c.event_idx, g.spent + c.cost AS spent, list_append(g.taken, c.event_idx) AS taken, list_transform(range(1, len(g.r) + 1), lambda k: g.r[k] + p.pi[k]) AS r,
                round((b.rels[c.event_idx + 1] + list_sum(list_transform(range(1, len(g.r) + 1), lambda k: b.rels[k] * (ln(1 + g.r[k] + p.pi[k]) - ln(1 + g.r[k]))))) / c.cost, 9) AS density
            FROM v_greedy g JOIN v_rels b ON b.query_id = g.query_id AND b.video_id = g.video_id JOIN v_costs c ON c.video_id = g.video_id JOIN v_pi p ON p.video_id = g.video_id AND p.src = c.event_idx
            WHERE NOT list_contains(g.taken, c.event_idx) AND g.spent + c.cost <= 2304)
        WHERE density > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY density DESC, event_idx) = 1""",
    "v_selected": "SELECT query_id, video_id, event_idx, pick_order FROM v_greedy WHERE pick_order > 0",
    "v_drawn": "SELECT query_id, video_id, event_idx, cost, row_number() OVER (PARTITION BY query_id ORDER BY md5('0-' || query_id || '-' || event_idx), event_idx) AS n FROM v_rel JOIN v_costs USING (video_id, event_idx)",
    "v_fit": "SELECT query_id, video_id, 0::BIGINT AS n, -1 AS event_idx, 0.0::DOUBLE AS spent, false AS taken, 0 AS pick_order FROM v_rels UNION ALL SELECT f.query_id, f.video_id, d.n, d.event_idx, CASE WHEN f.spent + d.cost <= 2304 THEN f.spent + d.cost ELSE f.spent END, f.spent + d.cost <= 2304, f.pick_order + CASE WHEN f.spent + d.cost <= 2304 THEN 1 ELSE 0 END FROM v_fit f JOIN v_drawn d ON d.query_id = f.query_id AND d.n = f.n + 1",
    "v_cand": "SELECT s.query_id, s.video_id, e.src, e.dst, e.weight FROM v_sem e JOIN v_selected s ON s.video_id = e.video_id AND s.event_idx = e.src JOIN v_selected t ON t.query_id = s.query_id AND t.video_id = e.video_id AND t.event_idx = e.dst",
    "v_replies": "SELECT query_id, src, dst, CASE (src * 7 + dst * 3 + query_id) % 4 WHEN 0 THEN 'No, nothing ties them.' WHEN 1 THEN 'yes: subject ' || dst || ' returns.' ELSE 'Yes.' || chr(10) || 'Subject ' || (src + dst) || ' is in both' END AS reply FROM v_cand",
    "v_parsed": "SELECT query_id, src, dst, coalesce(starts_with(lower(lines[1]), 'yes'), false) AS keep, CASE WHEN starts_with(lower(lines[1]), 'yes') THEN coalesce(lines[2], trim(substr(lines[1], 4), ' .,:-')) END AS statement FROM (SELECT query_id, src, dst, list_filter(list_transform(string_split_regex(reply, '\\r?\\n'), lambda x: trim(x, chr(9) || chr(10) || chr(13) || ' ')), lambda x: x <> '') AS lines FROM v_replies)",
    "v_verified": "SELECT c.*, p.statement FROM v_cand c JOIN v_parsed p USING (query_id, src, dst) WHERE keep",
    "v_retained": "SELECT a.query_id, a.video_id, a.event_idx AS src, a.event_idx + 1 AS dst, 1.0::DOUBLE AS weight FROM v_selected a JOIN v_selected b ON b.query_id = a.query_id AND b.video_id = a.video_id AND b.event_idx = a.event_idx + 1 UNION ALL SELECT query_id, video_id, src, dst, weight FROM v_verified",
    "v_steps": "SELECT DISTINCT query_id, video_id, [src] AS path, 0.0::DOUBLE AS total FROM v_retained r WHERE NOT EXISTS (SELECT 1 FROM v_retained q WHERE q.query_id = r.query_id AND q.dst = r.src) UNION ALL SELECT s.query_id, s.video_id, list_append(s.path, r.dst), s.total + r.weight FROM v_steps s JOIN v_retained r ON r.query_id = s.query_id AND r.src = s.path[-1]",
    "v_full": "SELECT query_id, video_id, path, total / (len(path) - 1) AS score FROM v_steps s WHERE len(path) > 1 AND NOT EXISTS (SELECT 1 FROM v_retained r WHERE r.query_id = s.query_id AND r.src = s.path[-1]) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY path) <= 1000",
    "v_paths": "SELECT query_id, video_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, path) AS INTEGER) AS rank, path, score FROM v_full QUALIFY rank <= 8",
    # T
    "t_base": "SELECT user_id AS video_id, event_id, epoch_us(ts) AS us, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0::DOUBLE AS t, event_type, value FROM events",
    "t_videos": "SELECT video_id, 25.0::DOUBLE AS fps, CAST(floor(max(t) * 25.0::DOUBLE) AS BIGINT) AS total_frames, max(t) AS duration FROM t_base GROUP BY ALL",
    "t_cuts": "SELECT video_id, t AS cut_sec FROM t_base WHERE event_type = 'click'",
    "t_points": "SELECT DISTINCT video_id, c AS start_sec FROM (SELECT c.video_id, cut_sec AS c FROM t_cuts c JOIN t_videos USING (video_id) WHERE cut_sec > 0 AND cut_sec < duration UNION ALL SELECT video_id, 0.0::DOUBLE FROM t_videos WHERE duration > 0 UNION ALL SELECT video_id, duration FROM t_videos WHERE duration > 0)",
    "t_events": "SELECT video_id, CAST(row_number() OVER w - 1 AS INTEGER) AS event_idx, start_sec, lead(start_sec) OVER w AS end_sec FROM t_points WINDOW w AS (PARTITION BY video_id ORDER BY start_sec) QUALIFY end_sec IS NOT NULL",
    "t_m": "SELECT *, CAST(least(greatest(ceil((end_sec - start_sec) / 4.0::DOUBLE), 1), 4) AS INTEGER) AS m FROM t_events",
    # Q
    "q_base": "SELECT conv_id * 1000 + turn AS id, chr(CAST(65 + (conv_id * 1000 + turn) % 4 AS INTEGER)) AS l, * FROM conversations",
    "q_replies": "SELECT id, CASE (conv_id + turn) % 8 WHEN 0 THEN 'The answer is ' || l || '.' WHEN 1 THEN '(' || lower(l) || ')' WHEN 2 THEN l || '. the man' WHEN 3 THEN 'A man walks' WHEN 4 THEN 'The answer is because it' WHEN 5 THEN 'it was E.' WHEN 6 THEN text ELSE '  Option: (' || l || ') I think' || chr(10) END AS reply FROM q_base",
    "q_results": "SELECT doc_id AS id, CASE WHEN doc_id % 10 <> 0 THEN chr(65 + quality) END AS pred, CASE WHEN doc_id % 11 = 0 THEN '' ELSE chr(65 + toxic) END AS gt FROM labels",
    "q_samples": "SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 7 <> 0 THEN '/videos/' || source END AS video_path, chr(CAST(65 + doc_id % 4 AS INTEGER)) AS answer FROM documents",
}


def sql(body: str, instead: dict[str, str] | None = None) -> str:
    """body after the expressions that it needs; instead: others, some in the place of those here."""
    tables, order = CTES | (instead or {}), []

    def need(text: str, inside: str = "") -> None:
        for name in re.findall(r"\b[dvtq]_[a-z]+\b", text):
            if name in tables and name != inside and name not in order:
                need(tables[name], name)
                if name not in order:
                    order.append(name)

    need(body)
    kept = ", ".join(f"{name} AS ({tables[name]})" for name in order)
    return f"WITH RECURSIVE {kept} {body}" if order else body


def vocabulary_rounds(words: int, rounds: int, packed: bool = False) -> str:
    """Rounds of spherical k-means over v_patches, one table of centroids after the other; packed: as lists."""
    place = "event_idx || '-' || frame_no || '-' || patch_no"
    order = "PARTITION BY video_id ORDER BY md5('{seed}-' || " + place + "), event_idx, frame_no, patch_no"
    unit = _UNIT.format(v="total")
    tables = [
        "p AS MATERIALIZED (SELECT * FROM v_patches WHERE list_dot_product(u, u) > 0)",
        f"b0 AS MATERIALIZED (SELECT video_id, CAST(row_number() OVER ({order.format(seed='start-0')}) - 1 AS INTEGER) AS word_id, u AS c FROM p QUALIFY word_id < {words})",
        f"d AS MATERIALIZED (SELECT video_id, u, row_number() OVER ({order.format(seed='spare-0')}) - 1 AS n, least({words}, count(*) OVER (PARTITION BY video_id)) AS spares FROM p QUALIFY n < {words})",
    ]
    for k in range(rounds):
        tables += [
            f"a{k} AS MATERIALIZED (SELECT p.video_id, word_id, u FROM p JOIN b{k} USING (video_id) QUALIFY row_number() OVER (PARTITION BY video_id, event_idx, frame_no, patch_no ORDER BY round(list_dot_product(u, c), 9) DESC, word_id) = 1)",
            f"s{k} AS (SELECT video_id, word_id, list(x ORDER BY d) AS total FROM (SELECT video_id, word_id, d, sum(u[d + 1]) AS x FROM a{k}, (SELECT unnest(range(8)) AS d) GROUP BY ALL) GROUP BY ALL)",
            f"e{k} AS (SELECT video_id, word_id, c, total, row_number() OVER (PARTITION BY video_id, total IS NULL ORDER BY word_id) - 1 AS n FROM b{k} LEFT JOIN s{k} USING (video_id, word_id))",
            f"b{k + 1} AS MATERIALIZED (SELECT e.video_id, word_id, CASE WHEN total IS NOT NULL THEN {unit} ELSE coalesce(u, c) END AS c FROM e{k} e LEFT JOIN d ON d.video_id = e.video_id AND d.n = (e.n + {k}) % d.spares)",
        ]
    if packed:
        return f"SELECT * FROM (WITH {', '.join(tables)} SELECT video_id, word_id, c AS centroid FROM b{rounds})"
    return f"SELECT * FROM (WITH {', '.join(tables)} SELECT video_id, word_id, CAST(d AS INTEGER) AS dim, round(c[d + 1], 6) AS value FROM b{rounds}, (SELECT unnest(range(8)) AS d))"


def label(event: str) -> str:
    """The time label of an event of V."""
    return f"printf('%.1f', {event} * 25 / 10.0) || 's - ' || printf('%.1f', ({event} + 1) * 25 / 10.0) || 's'"


def context(record: str) -> str:
    """query_id, rank, context of the paths in v_paths; record: an expression of s.query_id and s.e."""
    return f"""
        SELECT query_id, rank, string_agg(line, chr(10) ORDER BY k) AS context
        FROM (
            SELECT s.query_id, s.rank, s.k, 'Event ' || s.k || ' (' || {label("s.e")} || '):' || chr(10) || {record} || CASE
                WHEN s.nxt IS NULL THEN '' WHEN v.statement IS NOT NULL THEN chr(10) || '[Relation: ' || v.statement || ']' ELSE chr(10) || '[Next in time]' END AS line
            FROM (SELECT query_id, rank, k, path[k] AS e, path[k + 1] AS nxt FROM (SELECT query_id, rank, path, unnest(range(1, len(path) + 1)) AS k FROM v_paths)) s
            LEFT JOIN v_verified v ON v.query_id = s.query_id AND v.src = s.e AND v.dst = s.nxt)
        GROUP BY ALL"""


def rule_answers(words: int, rounds: int, question: str, options: list[str], grounding: int, verification: int, synthesis: int, rest: str) -> str:
    """The whole method over V with the model that replies by the length of prompts. question: an expression of query_id;
    the numbers are the lengths of the prompts without what is filled in; rest: the columns, from v_voted."""
    formatted = "".join(f"{chr(10)}{chr(65 + k)}. {x}" for k, x in enumerate(options))
    single = CTES["v_paths"]
    tables = {
        "v_codebook": vocabulary_rounds(words, rounds, packed=True),
        "v_asked": f"SELECT query_id, length({question}) + {len(formatted)} AS size FROM v_queries",
        "v_record": f"SELECT query_id, event_idx, {label('event_idx')} AS label, 'seen in ' || n_frames || ' frames: ' || ({grounding} + length({label('event_idx')}) + size) % 11 AS record FROM v_selected JOIN v_costs USING (video_id, event_idx) JOIN v_asked USING (query_id)",
        "v_verified": f"SELECT * EXCLUDE (n), 'Tied by ' || n % 7 || '.' AS statement FROM (SELECT c.*, {verification} + length(a.label) + length(a.record) + length(b.label) + length(b.record) + size AS n FROM v_cand c JOIN v_record a ON a.query_id = c.query_id AND a.event_idx = c.src JOIN v_record b ON b.query_id = c.query_id AND b.event_idx = c.dst JOIN v_asked q ON q.query_id = c.query_id) WHERE n % 4 <> 0",
        "v_best": single,
        "v_paths": "SELECT * FROM v_best UNION ALL SELECT query_id, video_id, 1, list(event_idx ORDER BY event_idx), 1.0::DOUBLE FROM v_selected s WHERE NOT EXISTS (SELECT 1 FROM v_best p WHERE p.query_id = s.query_id) GROUP BY query_id, video_id",
        "v_told": context("(SELECT record FROM v_record r WHERE r.query_id = s.query_id AND r.event_idx = s.e)"),
        "v_heard": f"SELECT query_id, rank, ({synthesis} + length(context) + size) % 5 AS k FROM v_told JOIN v_asked USING (query_id)",
        "v_voted": f"SELECT query_id, chr(CAST(65 + k AS INTEGER)) AS pred, sum(score) AS score FROM v_heard JOIN v_paths USING (query_id, rank) WHERE k < {len(options)} GROUP BY query_id, k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, min(rank)) = 1",
    }
    return sql(rest, tables)
