"""SQL of corpus queries that takes more than a few lines, put together from repeated pieces."""

from __future__ import annotations


def vector_codes(rounds: int = 4) -> str:
    """Brute force: every part meets every entry of its codebook; of the nearest the lowest index."""
    # a part's entries are compared without any order or bound
    def nearest(codes: str) -> str:
        far = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))::BIGINT"
        return (f"SELECT row, part, min({{'d': d, 'e': entry}}) AS best FROM (SELECT p.row, p.part, c.entry, {far} AS d FROM parts p "
                f"JOIN {codes} c ON p.part = c.part) GROUP BY ALL")

    steps = ["books0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM parts WHERE row <= 256)"]
    for k in range(rounds):
        steps.append(f"near{k} AS MATERIALIZED ({nearest(f'books{k}')})")
        steps.append(f"""books{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{k} b LEFT JOIN (
  SELECT part, entry, list(x ORDER BY i) AS v FROM (SELECT p.part, n.best.e AS entry, i, floor(sum(p.v[i])::DOUBLE / count(*))::BIGINT AS x
  FROM near{k} n JOIN parts p ON n.row = p.row AND n.part = p.part, range(1, 4097) t(i) WHERE i <= len(p.v) GROUP BY ALL) GROUP BY ALL) m
  ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v,
  row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS v FROM kept, range(4) t(part)),
{", ".join(steps)}, last AS ({nearest(f"books{rounds}")}),
coded AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY row)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM books{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (row)"""


def conversation_repair() -> str:
    """The lattice as a recursion over rows: each state's least (cost, edits, text), ties as the query breaks them."""
    def then(label: str, cost: str, edit: str, line: str | None = None) -> str:
        text = f"{label}.r" if line is None else f"{label}.r || CASE WHEN {label}.r = '' THEN '' ELSE chr(10) END || {line}"
        return f"CASE WHEN {label} IS NOT NULL THEN {{'c': {label}.c + {cost}, 'a': {label}.a || '{edit}', 'r': {text}}} END"

    def row(target: int, sources: str, initial: str, role: str) -> str:
        """All ways to a state by one row: its deletion, or keeping or renaming it from the states before."""
        ways = [then(f"l{target}", "2", "D")]
        for s in sources:
            ways.append(f"CASE WHEN x.ok AND x.role[1] = '{initial}' THEN {then(f'l{s}', 'x.more', 'K', line)} END")
            if role:
                ways.append(f"CASE WHEN x.ok THEN {then(f'l{s}', '(1 + x.more)', 'R', chr(39) + role + ':' + chr(39) + ' || x.text')} END")
        return f"least({', '.join(ways)})" if len(ways) > 1 else ways[0]

    line = "x.role || ':' || x.text"
    label = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
    user, helper = (f"'{r}:'" for r in ("user", "assistant"))
    l2 = f"least(l2, {then('l0', '5', 'I', user)}, {then('l1', '5', 'I', user)}, {then('l3', '5', 'I', user)})"
    return f"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
  ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS bytes FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) t(copy)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS bare FROM damaged),
faults AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
  WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
convs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND coalesce(before[1], '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal,
  list({{'role': role, 'text': text, 'ok': fault NOT IN ('blank', 'duplicate'), 'more': CASE fault WHEN 'truncated' THEN 5 ELSE 0 END}} ORDER BY i) AS rows
  FROM faults GROUP BY conv_id),
stepped AS (SELECT conv_id, rows, 0 AS i, {{'c': 0, 'a': '', 'r': ''}}::{label} AS l0, NULL::{label} AS l1,
    {{'c': 5, 'a': 'I', 'r': 'user:'}}::{label} AS l2, {{'c': 10, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}}::{label} AS l3 FROM convs
  UNION ALL
  SELECT conv_id, rows, i, l0, l1, {l2} AS l2, least(l3, {then(l2, '5', 'I', helper)}) AS l3 FROM (
    SELECT conv_id, rows, i + 1 AS i, {row(0, '', '', '')} AS l0, {row(1, '0', 's', '')} AS l1, {row(2, '013', 'u', 'user')} AS l2,
      {row(3, '2', 'a', 'assistant')} AS l3 FROM (SELECT *, rows[i + 1] AS x FROM stepped WHERE i < len(rows)))),
ends AS (SELECT conv_id, least(l0, l3) AS b FROM stepped WHERE i = len(rows))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(b.r, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN convs c ON o.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""
