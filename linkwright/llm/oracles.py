"""DuckDB SQL of the operators that SQL can express, over the whole tables."""

from __future__ import annotations

from .op10_lines import BANG_PERCENT, BOILERPLATE, LONG_LINE, MAX_REPEAT_PERCENT, MIN_WORDS, NAV_MARKS, SYMBOL_PERCENT

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP7 = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS s
        FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT DISTINCT r, k FROM (SELECT win.r, unnest(range(win.i, win.i + 50)) AS k FROM win JOIN least ON win.s = least.s AND win.doc_id > least.d)),
word AS (SELECT r, doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT word.r, count(*) AS n_words, count(hit.k) AS n_removed,
                coalesce(string_agg(CASE WHEN hit.k IS NULL THEN x END, ' ' ORDER BY word.k), '') AS t
         FROM word LEFT JOIN hit ON word.r = hit.r AND word.k = hit.k GROUP BY word.r)
SELECT w.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.r = kept.r
"""

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, ws, least(len(ws), 10) AS n FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM b)),
text AS (SELECT r, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS s
         FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
found AS (SELECT r, i, text.n, item_id FROM text JOIN win ON text.n = win.n AND text.s = win.s),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM found) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN item ON d.r = item.r
"""

_phrases = " OR ".join(f"contains(low, '{x}')" for x in BOILERPLATE)
OP10 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
b AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
tri AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 2), ' ') AS s
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM b WHERE len(ws) >= 3)),
often AS (SELECT r, s FROM tri GROUP BY r, s HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT tri.r, unnest(range(i, i + 3)) AS k FROM tri JOIN often USING (r, s)) GROUP BY r),
cut AS (SELECT r, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM d),
line AS (SELECT *, translate(line, '{_UPPER}', '{_LOWER}') AS low, len(regexp_extract_all(line, '{_WORD}')) AS n,
                length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS marks,
                row_number() OVER (PARTITION BY r, line ORDER BY k) > 1 AS dup FROM cut),
judged AS (SELECT *, dup OR length(regexp_replace(line, '[^|]', '', 'g')) >= {NAV_MARKS} OR 100 * marks > {SYMBOL_PERCENT} * chars
                OR 100 * length(regexp_replace(line, '[^!]', '', 'g')) > {BANG_PERCENT} * n
                OR (n >= {LONG_LINE} AND NOT regexp_matches(line, '[.,;:!?]')) OR {_phrases} AS fails FROM line WHERE n > 0),
lines AS (SELECT r, count(*) FILTER (dup) AS n_dup, coalesce(sum(n) FILTER (fails), 0) AS lost FROM judged GROUP BY r),
base AS (SELECT b.r, doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
                length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
                coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
         FROM b LEFT JOIN rep ON b.r = rep.r LEFT JOIN lines ON b.r = lines.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 2 * lost <= n_words AS kept
FROM base
"""


OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
p AS (SELECT r, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) s(k) WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, a, c.k AS size, s.k, array_to_string(ws[1:s.k], ' ') AS x, array_to_string(ws[s.k + 1:], ' ') AS y FROM c, range(1, 5) s(k) WHERE s.k < c.k),
score AS (SELECT cut.lang, cut.phrase, cut.a, cut.size, cut.k, l.f AS l, r.f AS r, n.n, ((1000::HUGEINT * a * n.n) // (l.f::HUGEINT * r.f)) AS score
          FROM cut JOIN f l ON l.lang = cut.lang AND l.phrase = x JOIN f r ON r.lang = cut.lang AND r.phrase = y JOIN n ON n.lang = cut.lang),
low AS (SELECT * FROM score QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
           FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 5) t(m) WHERE m < k) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM kept QUALIFY rank <= 2000
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text by the table tab, which the query has to have."""
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295)"


OP13 = f"""
WITH RECURSIVE
t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
raw AS (SELECT *, unnest(range(greatest(coalesce(click_id % 3, 0), 0) + 1)) AS j FROM clicks WHERE arrived_at IS NOT NULL),
coded AS (SELECT raw.*, {_crc32("coalesce(click_id::VARCHAR, '') || ':' || j::VARCHAR")} AS c FROM raw, t),
timed AS (SELECT click_id, floor(epoch_us(arrived_at) / 3600000000)::BIGINT + 6 * j * (c % 10) AS hour, c,
                 sha256(coalesce(client_id::VARCHAR, '') || '|' || coalesce(kind, '') || '|' || coalesce(floor(100 * value + 0.5)::BIGINT::VARCHAR, '') || '|'
                        || coalesce(epoch_us(ts)::VARCHAR, '') || '|' || coalesce(props, '') || '|' || (c % 3)::VARCHAR) AS hash FROM coded),
late AS (SELECT click_id, hour, hash, hour + (c // 10) % 200 AS l FROM timed),
cut AS (SELECT click_id, hour, hash, ((l - min(l) OVER ()) * 12) // (max(l) OVER () - min(l) OVER () + 1) AS batch FROM late),
step AS (SELECT b, (SELECT max(hour) FROM cut WHERE batch < b) AS m FROM range(13) r(b)),
kept AS (SELECT click_id, hour, hash, batch, row_number() OVER (PARTITION BY click_id ORDER BY batch, hour, hash) AS k
         FROM cut JOIN step ON b = batch WHERE batch = 0 OR hour >= m - 48),
walk AS (SELECT click_id, k, hour AS start_hour, batch AS opened, hash AS opener, 1 AS w, hash, batch FROM kept WHERE k = 1
         UNION ALL
         SELECT kept.click_id, kept.k, CASE WHEN kept.hour <= start_hour + 72 THEN start_hour ELSE kept.hour END, CASE WHEN kept.hour <= start_hour + 72 THEN opened ELSE kept.batch END,
                CASE WHEN kept.hour <= start_hour + 72 THEN opener ELSE kept.hash END, CASE WHEN kept.hour <= start_hour + 72 THEN w ELSE w + 1 END, kept.hash, kept.batch
         FROM walk JOIN kept ON kept.click_id IS NOT DISTINCT FROM walk.click_id AND kept.k = walk.k + 1),
summed AS (SELECT click_id, w, any_value(start_hour) AS start_hour, any_value(opened) AS opened, any_value(opener) AS hash, count(*) - 1 AS n_repeats, count(*) FILTER (walk.hash <> opener) AS n_conflicts,
                  coalesce(sum({_crc32("walk.hash")}) FILTER (walk.hash <> opener), 0) AS conflict_crc
           FROM walk, t GROUP BY click_id, w),
ends AS (SELECT *, lead(opened) OVER (PARTITION BY click_id ORDER BY w) AS next FROM summed)
SELECT click_id, start_hour, least(coalesce(next, 11), coalesce((SELECT min(b) - 1 FROM step WHERE b > opened AND start_hour + 72 < m - 48), 11), 11)::BIGINT AS closed_batch,
       n_repeats::BIGINT AS n_repeats, n_conflicts::BIGINT AS n_conflicts, conflict_crc::BIGINT AS conflict_crc, hash
FROM ends
"""
