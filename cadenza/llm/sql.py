"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), u AS (
  SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.a LEFT JOIN counts c ON e.vec_id = c.a
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(24 + length({_ESCAPED.format("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")}) + length({_ESCAPED.format("text")})) AS n
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(n AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
FROM whole
"""

LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), held AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.line, k.pos, h.first IS NOT NULL AND h.first <> k.doc_id AS gone FROM keyed k LEFT JOIN held h ON k.key = h.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def mixing(entropy: float = 0.9, repeats: float = 4.0, seed: int = 1, block_tokens: int = 100_000, max_blocks: int = 65_536) -> str:
    """The mix without a budget, with the module's bisection of 4 passes over 63 points."""
    good = {
        "e": f"ln(sum(exp(a * ln(p)))) - a * sum(exp(a * ln(p)) * ln(p)) / sum(exp(a * ln(p))) >= CAST({entropy} AS DOUBLE) * ln(count(*))",
        "r": f"exp((a - 1) * (ln(min(p)) - ln(max(p)))) > CAST({repeats} AS DOUBLE)",
    }
    ctes = []
    for g, test in good.items():
        ctes.append(f"{g}0 AS (SELECT CAST(0 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high)")
        for k in range(1, 5):
            ctes.append(
                f"{g}{k} AS (SELECT low + best * step AS low, low + (best + 1) * step AS high FROM (SELECT min(low) AS low, min(step) AS step, "
                f"coalesce(max(CASE WHEN good THEN k END), 0) AS best FROM (SELECT k, min(low) AS low, min(step) AS step, {test} AS good FROM "
                f"(SELECT p, k, low, (high - low) / 64 AS step, low + k * ((high - low) / 64) AS a FROM shares, {g}{k - 1}, range(1, 64) t(k)) GROUP BY k, a)))"
            )
    return f"""
WITH docs AS (
  SELECT doc_id, source AS given, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n,
    CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS u,
    md5('{seed}-last|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), sources AS (SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM docs GROUP BY source),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total FROM sources),
shares AS (SELECT tokens / total AS p FROM sources, total WHERE tokens > 0),
{", ".join(ctes)},
found AS (SELECT greatest(e4.low, CASE WHEN (SELECT max(p) > min(p) * {repeats} FROM shares) THEN r4.high ELSE 0 END) AS a FROM e4, r4),
powers AS (SELECT source, tokens, exp(a * ln(tokens / total)) AS w FROM sources, total, found WHERE tokens > 0),
top AS (SELECT CAST(max(tokens) AS DOUBLE) AS most, max(w) AS top FROM powers),
due AS (SELECT source, tokens, greatest(least(CAST(floor(w * (most / top) + 1e-6) AS BIGINT), CAST(floor(tokens * {repeats}) AS BIGINT)), tokens) AS due FROM powers, top
  UNION ALL SELECT source, tokens, 0 FROM sources WHERE tokens = 0),
named AS (SELECT *, CASE WHEN tokens > 0 THEN due // tokens ELSE 1 END AS passes,
  CAST(ceil(greatest(tokens, 1) / greatest({block_tokens}, CAST(ceil(total / {max_blocks}) AS BIGINT))) AS BIGINT) AS blocks FROM due, total),
dealt AS (SELECT d.*, d.u % s.blocks AS block, s.passes, s.due - s.passes * s.tokens AS rest FROM docs d JOIN named s ON d.source = s.source),
plan AS (SELECT source, block, sum(n) AS n, min(passes) AS passes, min(rest) AS rest FROM dealt GROUP BY source, block),
ordered AS (SELECT *, rest - (sum(n) OVER (PARTITION BY source ORDER BY md5('{seed}|' || passes || '|' || source || '|' || block), block ROWS UNBOUNDED PRECEDING) - n) AS due_left FROM plan),
inside AS (SELECT d.*, o.due_left, o.n AS block_n,
  sum(d.n) OVER (PARTITION BY d.source, d.block ORDER BY d.place RANGE UNBOUNDED PRECEDING) AS upto
  FROM dealt d JOIN ordered o ON d.source = o.source AND d.block = o.block),
times AS (SELECT *, passes + CASE WHEN due_left > 0 AND (due_left >= block_n OR upto <= due_left) THEN 1 ELSE 0 END AS times FROM inside),
every AS (SELECT *, unnest(range(0, CAST(times AS BIGINT))) AS mix_pass FROM times)
SELECT doc_id, given AS source, mix_pass, block AS mix_block, md5('{seed}|' || mix_pass || '|' || source || '|' || block) AS mix_order FROM every
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": EMBEDDINGS, "op3_chat_format": CHAT, "op4_source_mixing": mixing(), "op5_line_dedup": LINES}
