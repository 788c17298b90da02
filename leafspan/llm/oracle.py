"""DuckDB SQL with the rows of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import AROUND, CHAR_CLASSES, COMMON_WORDS, LONGEST_COMMON

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = "list_filter(regexp_split_to_array({0}, '{1}'), lambda x: x <> '')"
_BENCH_WORDS = _SPLIT.format(_LOWER.format("text"), r"[^0-9a-z\x{80}-\x{10FFFF}]+")

OP8 = f"""WITH dw AS (SELECT doc_id, row_number() OVER () AS r, {_BENCH_WORDS} AS w FROM documents),
bw AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k:k + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS k FROM bw WHERE len(w) > 0)),
grams AS (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM dw, (SELECT DISTINCT n FROM win))),
hits AS (SELECT r, k, n, item_id FROM grams JOIN win USING (g, n)),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN covered USING (r) LEFT JOIN items USING (r)"""


def _distance(shares: list[str], reference: list[float]) -> str:
    """Jensen-Shannon distance of shares, the last of them what is left, to a reference."""
    shares = [*shares, f"greatest(0.0, 1.0 - {' - '.join(shares)})"]
    reference = [*reference, 1.0 - sum(reference)]
    terms = []
    for p, q in zip(shares, reference, strict=True):
        mid = f"(({p}) + {q!r}) / 2"
        terms.append(f"CASE WHEN ({p}) > 0 THEN ({p}) * log2(({p}) / ({mid})) ELSE 0.0 END + {q!r} * log2({q!r} / ({mid}))")
    return f"sqrt(greatest(({' + '.join(terms)}) / 2, 0.0))"


def _least(by_language: dict[str, str]) -> str:
    known = ", ".join(f"'{c}'" for c in by_language)
    return "least(" + ", ".join(f"CASE WHEN lang = '{c}' OR lang IS NULL OR lang NOT IN ({known}) THEN {d} END" for c, d in by_language.items()) + ")"


def _op10() -> str:
    size = "greatest(length(text), 1)::DOUBLE"
    chars = [f"c.{k} / {size}" for k in ("blank", "upper", "stop", "symbol")]
    char_distance = _least({c: _distance(chars, list(v.values())) for c, v in CHAR_CLASSES.items()})
    names = sorted({w for v in COMMON_WORDS.values() for w in v})
    n = {w: f"f.n{k}" for k, w in enumerate(names)}
    counts = ", ".join(f"len(list_filter(w, lambda x: x = '{w}')) AS n{k}" for k, w in enumerate(names))
    word_distance = _least({c: _distance([f"{n[w]} / greatest(n_words, 1)::DOUBLE" for w in v], list(v.values())) for c, v in COMMON_WORDS.items()})
    around = AROUND.replace("'", "''")
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {_SPLIT.format("coalesce(text, '')", r"[ \t\n\x0B\x0C\r]+")} AS w,
list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\x0C\r]')) AS l FROM documents),
b AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines FROM d),
g AS (SELECT r, k, count(*) OVER (PARTITION BY r, w[k], w[k + 1], w[k + 2]) AS n FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d)),
s AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
c AS (SELECT r, length(text) - word_chars AS blank, length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g')) AS upper, length(text) - length(regexp_replace(text, '[.,;:!?''"()\-]+', '', 'g')) AS stop, n_symbols AS symbol FROM b),
f AS (SELECT r, {counts} FROM (SELECT r, list_transform(list_filter(w, lambda x: length(x) <= {LONGEST_COMMON}), lambda x: lower(trim(x, '{around}'))) AS w FROM d)),
m AS (SELECT doc_id, text, n_words, word_chars, n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {char_distance} AS cd, {word_distance} AS wd FROM b JOIN c USING (r) JOIN f USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((length(text) >= 200 AND cd > 0.16) OR (n_words >= 100 AND wd > 0.33)) AS kept, round(cd, 6) AS char_distance, round(wd, 6) AS word_distance FROM m"""


OP10 = _op10()


def _crc_step() -> str:
    """The table of the CRC's step over one byte, as a list."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 if c & 1 else c >> 1
        table.append(str(c))
    return f"[{', '.join(table)}]::BIGINT[]"


_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, ({_crc_step()})[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
_HEX8 = "('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE"

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents),
f AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
g AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM (SELECT {_BENCH_WORDS} AS w FROM benchmark)),
fc AS (SELECT f, count(*) AS n FROM f GROUP BY f), gc AS (SELECT f, count(*) AS n FROM g GROUP BY f),
b AS (SELECT f, {_CRC} % 10000 AS b FROM (SELECT f FROM fc UNION SELECT f FROM gc)),
s AS (SELECT b, sum(n) AS s FROM fc JOIN b USING (f) GROUP BY b), t AS (SELECT b, sum(n) AS t FROM gc JOIN b USING (f) GROUP BY b),
gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (b)),
m AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (b) GROUP BY r),
k AS (SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(({_HEX8} + 0.5) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN m USING (r)),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER () AS able FROM k WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= able * 25 // 100 THEN place END AS rank FROM o UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM k WHERE words < 20"""


def _cheapest(*ways: str) -> str:
    """The least of lists of (cost, audit, text)."""
    return f"list_min([{', '.join(ways)}])"


def _op12() -> str:
    name = "coalesce(CAST({0} AS VARCHAR), ' ')"
    key = f"{name.format('conv_id')} || ':' || {name.format('turn')}"
    way = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}', 't': {3}}}".format
    add = "{0}.t || [{1}]".format
    # Behind a row: deleted, kept or given another role, from each place; then what is inserted.
    kept = lambda p, letter, first: way(p, f"CASE WHEN NOT gone AND i = '{first}' THEN late ELSE 1000000000 END", letter, add(p, "role || ':' || text"))
    told = lambda p, role: way(p, "CASE WHEN NOT gone THEN 2 + late ELSE 1000000000 END", "R", add(p, f"'{role}:' || text"))
    deleted = lambda p: way(p, "3", "D", f"{p}.t")
    more = lambda p, role: way(p, "2", "I", add(p, f"'{role}:'"))
    user = [f(p, *a) for p in ("p0", "p1", "p3") for f, a in ((kept, "Ku"), (told, ["user"]))]
    none = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    start = "{'c': 0, 'a': '', 't': []::VARCHAR[]}"
    behind_user = lambda ps: _cheapest("p2", *[more(p, "user") for p in ps])
    return rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, {name.format("role")} AS role, {name.format("text")} AS text, (SELECT {_CRC.replace("encode(f)", f"encode({key})")}) % 20 AS k FROM conversations),
x AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE k <> 0),
y AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM x),
z AS (SELECT *, substr(role, 1, 1) AS i, body = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, substr(body, length(body), 1) NOT IN ('.', '!', '?') AS open, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM y),
r AS (SELECT *, blank OR again AS gone, CASE WHEN open THEN 1 ELSE 0 END AS late, before IS NOT NULL AND substr(before, 1, 1) || i NOT IN ('su', 'ua', 'au') AS bad FROM z),
c AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT gone) AS truncated, count(*) FILTER (bad) AS illegal, count(*) AS rows FROM r GROUP BY conv_id),
s0 AS (SELECT conv_id, 0 AS n, {start} AS p0, {none} AS p1, {{'c': 2, 'a': 'I', 't': ['user:']}} AS p2, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS p3 FROM c),
s AS (SELECT * FROM s0 UNION ALL SELECT conv_id, n, p0, p1, q2 AS p2, {_cheapest("p3", more("p2", "assistant"), more("u0", "assistant"), more("u1", "assistant"))} AS p3 FROM (SELECT *, {more("p0", "user")} AS u0, {more("p1", "user")} AS u1, {behind_user(["p0", "p1", "p3"])} AS q2 FROM (SELECT s.conv_id, s.n + 1 AS n, {deleted("p0")} AS p0, {_cheapest(deleted("p1"), kept("p0", "K", "s"))} AS p1, {_cheapest(deleted("p2"), *user)} AS p2, {_cheapest(deleted("p3"), kept("p2", "K", "a"), told("p2", "assistant"))} AS p3 FROM s JOIN r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = s.n + 1))),
e AS (SELECT conv_id, {_cheapest("p0", "p3")} AS best FROM s JOIN c USING (conv_id) WHERE n = rows UNION ALL SELECT s.conv_id, {_cheapest("p0", "p3")} FROM s JOIN c ON s.conv_id IS NULL AND c.conv_id IS NULL AND n = rows)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON o.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id"""


OP12 = _op12()
