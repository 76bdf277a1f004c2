"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tallyframe.llm import chat_format, url_filter
from tallyframe.llm.queries import PROBE

ORACLES: dict[str, str] = {}

LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_words = url_filter.Vocabulary()
_by_term: dict[str, list[str]] = {}
for _form, (_term, _) in sorted(_words.forms.items()):
    _by_term.setdefault(_term, []).append(_form)
_terms = ", ".join(
    f"CASE WHEN regexp_matches(address, '(^|[^\\p{{L}}\\p{{N}}])({'|'.join(forms)})($|[^\\p{{L}}\\p{{N}}])') THEN '{term}' END"
    for term, forms in sorted(_by_term.items())
)
_weight = " ".join(f"WHEN '{term}' THEN {weight}" for term, weight in sorted(set(_words.forms.values())))
_rules = ", ".join(
    f"('{rule}', '{rule.split('/', 1)[0]}', '/{rule.split('/', 1)[1]}', '{action}')" for action, rule in url_filter.RULES
)
ORACLES["op4_url_filter"] = f"""
WITH split AS (
  SELECT page_id, coalesce({LOWER_AZ.format("url_decode(url)")}, '') AS address,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, address, {LOWER_AZ.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), fits AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts JOIN (VALUES {_rules}) r(rule, on_host, prefix, action)
    ON (host = on_host OR ends_with(host, '.' || on_host)) AND starts_with(path, prefix)
  GROUP BY page_id
), words AS (
  SELECT page_id, list_filter([{_terms}], lambda t: t IS NOT NULL) AS terms FROM parts
)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN coalesce(list_sum(list_transform(terms, lambda t: CASE t {_weight} END)), 0) >= {_words.reject_at}
    THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(terms, ',') AS terms
FROM parts LEFT JOIN fits USING (page_id) LEFT JOIN words USING (page_id)
"""

# The test pages have one article of headings, paragraphs and bold text each; this reads just that.
ORACLES["op1_html_extract"] = r"""
WITH cut AS (
  SELECT page_id, url, string_split_regex(
    regexp_replace(regexp_replace(coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), ''),
      '<br>', ' ', 'g'), '</?b>', '', 'g'), '</?(?:p|h1)>') AS parts
  FROM pages
), plain AS (
  SELECT page_id, url, list_transform(parts, lambda b: trim(regexp_replace(
    replace(replace(replace(replace(replace(replace(b, '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)),
      '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts
  FROM cut
), joined AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), chr(10)) AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM joined
"""

_words_of = (
    "regexp_extract_all(" + LOWER_AZ.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLES["op3_decontaminate"] = f"""
WITH items AS (SELECT item_id, {_words_of} AS w FROM benchmark),
docs AS (SELECT doc_id, {_words_of} AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS run
  FROM items, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS run
  FROM docs, (SELECT DISTINCT k FROM windows) ks, unnest(range(1, len(w) - k + 2)) t(i)
), found AS (SELECT DISTINCT doc_id, item_id, k, i FROM places JOIN windows USING (k, run)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + k)) t(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

_plain_words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLES["op8_substring_dedup"] = f"""
WITH docs AS (SELECT doc_id, {_plain_words} AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS run
  FROM docs, unnest(range(1, len(w) - 11)) t(i)
),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY run) AS low FROM windows) WHERE low < doc_id
),
removed AS (SELECT doc_id, list(DISTINCT p) AS gone FROM repeated, unnest(range(i, i + 13)) t(p) GROUP BY doc_id),
kept AS (
  SELECT doc_id, array_to_string(list(w[p] ORDER BY p), ' ') AS kept
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)
  ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM removed) USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_lower_words = "regexp_extract_all(" + LOWER_AZ.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"

ORACLES["op10_exact_dedup"] = f"""
WITH folded AS (SELECT doc_id, {LOWER_AZ.format("coalesce(text, '')")} AS content FROM documents),
groups AS (SELECT content, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY content)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256
FROM folded JOIN groups USING (content)
"""

_t = chat_format.Template()
_names = " ".join(f"WHEN '{role}' THEN {len(_t.heading(role))}" for role in _t.names)
_moves = ", ".join(f"('{state}', '{role}')" for state, moves in _t.states.items() for role in moves)
_leads = " ".join(f"WHEN '{role}' THEN '{state}'" for moves in _t.states.values() for role, state in moves.items())
_marks = " + ".join(
    f"len(list_filter(range(1, length(text) + 1), lambda i: substr(text, i, {len(mark)}) = '{mark}'))"
    for mark in ("\\", _t.mark.strip(), _t.end.strip())
)
_probe = ", ".join(f"({conv}, {turn}, '{role}', '{text}')" for conv, turn, role, text in PROBE)
ORACLES["op5_chat_format"] = f"""
WITH said AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES {_probe}
), turns AS (
  SELECT *, coalesce(CASE lag(role) OVER w {_leads} END, '{_t.start}') AS state, lead(role) OVER w IS NULL AS last,
    CASE role {_names} END + length(text) + {_marks} + {len(_t.end)} AS chars
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  (count(*) FILTER ((state, role) NOT IN ({_moves}))
    + count(*) FILTER (last AND CASE role {_leads} END NOT IN ({", ".join(f"'{s}'" for s in _t.final)})))::BIGINT AS n_errors
FROM turns GROUP BY conv_id
"""

# The reflected CRC-32 of a string, byte by byte, from the table of its polynomial.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of the UTF-8 bytes of ``text``; needs ``crc_table`` in scope."""
    digit = "strpos('123456789ABCDEF', substr(hex(encode({0})), {1}, 1))"
    high, low = digit.format(text, "2 * i - 1"), digit.format(text, "2 * i")
    code = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: 16 * {high} + {low})"
    step = "lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])"
    return f"xor(list_reduce(list_concat([4294967295], {code}), {step}), 4294967295)"


def _merkle_rounds(name: str, rounds: int) -> str:
    """Nodes of every level of the trees in ``{name}0`` (grp, rank, n, hash), and per leaf its path upwards.

    A tree with one node left stays as it is on the levels above.
    """
    out = []
    for k in range(rounds):
        out.append(f"""{name}{k + 1} AS (
  SELECT grp, rank // 16 AS rank, max(n) AS n,
    CASE WHEN max(n) > {16**k} THEN sha256(string_agg(hash, '' ORDER BY rank)) ELSE min(hash) END AS hash
  FROM {name}{k} GROUP BY grp, rank // 16
), {name}_sides{k} AS (
  SELECT *, CASE WHEN n > {16**k} THEN coalesce(string_agg(hash, '') OVER (
      PARTITION BY grp, rank // 16 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
    CASE WHEN n > {16**k} THEN coalesce(string_agg(hash, '') OVER (
      PARTITION BY grp, rank // 16 ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {name}{k}
)""")
    return ",\n".join(out)


def _merkle_path(alias: str, rounds: int) -> tuple[str, str]:
    """Joins of a leaf to the levels above it, and the list of its siblings, left and right of a bar."""
    joins, steps = "", []
    for k in range(rounds):
        side = f"{alias}s{k}"
        joins += f" JOIN {alias}_sides{k} {side} ON {side}.grp = {alias}0.grp AND {side}.rank = {alias}0.rank // {16**k}"
        steps.append(f"CASE WHEN {side}.n > {16**k} THEN {side}.l || '|' || {side}.r END")
    return joins, f"[{', '.join(steps)}]"


def _merkle(levels: int = 6, source_levels: int = 4) -> str:
    def leaf(text: str) -> str:
        parts = (
            f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')"
            for c in ("doc_id", "source", "lang", "n_chars", text)
        )
        return f"sha256({' || '.join(parts)})"

    joins, steps = _merkle_path("leaf", levels)
    top_joins, top_steps = _merkle_path("tree", source_levels)
    fold = "lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))"
    return f"""
WITH {CRC_TABLE}, leaf0 AS (
  SELECT doc_id, coalesce('+' || source, '-') AS grp, source, {leaf("text")} AS hash,
    CASE WHEN {crc32("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(LOWER_AZ.format("text"))} END AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {leaf("text")}) - 1 AS rank,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents, crc_table
), {_merkle_rounds("leaf", levels)},
tree0 AS (
  SELECT 'all' AS grp, l.grp AS member, hash,
    row_number() OVER (ORDER BY s.source NULLS FIRST) - 1 AS rank, count(*) OVER () AS n
  FROM leaf{levels} l JOIN (SELECT DISTINCT grp, source FROM leaf0) s USING (grp)
), {_merkle_rounds("tree", source_levels)},
upper_part AS (SELECT tree0.member, tree0.hash AS subroot, {top_steps} AS steps FROM tree0{top_joins}),
proofs AS (
  SELECT leaf0.doc_id, leaf0.hash AS leaf, coalesce(leaf0.tampered, leaf0.hash) AS given, subroot,
    list_filter(list_concat({steps}, upper_part.steps), lambda s: s IS NOT NULL) AS steps
  FROM leaf0{joins} JOIN upper_part ON member = leaf0.grp
)
SELECT doc_id, leaf, subroot, t.hash AS root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256,
  list_reduce(steps, {fold}, given) AS folded_root, folded_root = root AS verified
FROM proofs CROSS JOIN tree{source_levels} t
"""


ORACLES["op13_merkle_manifest"] = _merkle()

# Two words are near if one is the other less a code point, or both are alike without the code point at one place.
ORACLES["op11_variant_grouping"] = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all({LOWER_AZ.format("coalesce(text, '')")}, '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run
), sums AS (
  SELECT *, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM runs, crc_table
), words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM sums
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), less AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)
), pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), known AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM pairs GROUP BY word
), formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form,
    CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN known USING (word)
), chain AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT f.word, c.root FROM chain c JOIN formed f ON f.form = c.word
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
