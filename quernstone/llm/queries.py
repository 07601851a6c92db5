"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from quernstone.llm.codes import op11
from quernstone.llm.contamination import op7
from quernstone.llm.forest import op10
from quernstone.llm.jaccard import op9
from quernstone.llm.language import op6
from quernstone.llm.lines import op1
from quernstone.llm.minhash import op13
from quernstone.llm.mixing import op3
from quernstone.llm.quality import op2
from quernstone.llm.records import op5
from quernstone.llm.sharding import op4
from quernstone.llm.trie import op12
from quernstone.llm.urls import RULES, op8

QUERIES = {
    "op1_lines": op1,
    "op2_quality": op2,
    "op3_mixing": op3,
    "op4_sharding": op4,
    "op5_records": op5,
    "op6_language": op6,
    "op7_decontamination": op7,
    "op8_urls": op8,
    "op9_jaccard_join": op9,
    "op10_forest": op10,
    "op11_codes": op11,
    "op12_trie": op12,
    "op13_minhash": op13,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _shingles(width: int = 5) -> str:
    return f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i : i + {width - 1}], ' '))) END"


_MIX = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  greatest(0.05::DOUBLE, 1.0::DOUBLE - coalesce(len(regexp_extract_all(text, '[^\p{L}\s.,]'))::DOUBLE / greatest(length(text), 1), 0.0::DOUBLE)) AS w,
  md5(concat_ws('|', 'mix', coalesce('d' || doc_id::VARCHAR, ''), coalesce('s' || source, ''), md5(coalesce(text, '')))) AS key FROM documents),
k AS (SELECT doc_id, source, size, key, -ln((('0x' || left(key, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / w AS place FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM k GROUP BY source),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN cap / weight > level THEN level END) OVER () * weight, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.source, size, source_size, target, epochs, greatest(0.0::DOUBLE, target - epochs * source_size) AS rest, sum(size) OVER (PARTITION BY k.source ORDER BY place, key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
x AS (SELECT *, (epochs + CASE WHEN rest > 0 AND size > 0 AND upto - size * 0.5::DOUBLE <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM r)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM x"""

_LEAKS = f"""
WITH i AS (SELECT item_id, unnest({_shingles()}) AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
d AS (SELECT doc_id, unnest({_shingles()}) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n::INTEGER AS n_item, c::INTEGER AS n_common, round(c::DOUBLE / n, 6) AS containment FROM c JOIN n USING (item_id) WHERE 100 * c >= 75 * n"""


def _classes_sql(percent: int, width: int, more: str = "") -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_shingles(width)} AS sh FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
n AS (SELECT doc_id, len(sh) AS n FROM d),
x AS (SELECT doc_id, unnest(sh) AS s FROM d),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, coalesce(m.root, n.doc_id) AS component_id{more} FROM n LEFT JOIN m ON m.node = n.doc_id"""


def _urls_sql() -> str:
    """The rules, and the rounds of the propagation as a recursive table.

    There are as many rounds as hosts, so that every path has been gone, and 200
    at least, after which 0.85 to that power is left to come; one without links.
    """
    host = "translate(regexp_extract(coalesce({}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(RULES, key=lambda r: -len(r[0] + r[1]))]
    rule, says = (f"CASE {' '.join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits)} END" for i in (1, 2))
    return f"""
WITH RECURSIVE p AS (SELECT page_id, {host.format("url")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
j AS (SELECT *, {rule} AS rule, {says} AS says FROM p),
a AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1))) AS href FROM p),
g AS (SELECT src, {host.format("CASE WHEN starts_with(href, '//') THEN 'x:' || href ELSE href END")} AS dst FROM a),
e AS (SELECT src, dst, count(*) AS n FROM g WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
f AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
m AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS part FROM f),
h AS (SELECT host, sum((says = 'allow')::INT) AS t, sum((says = 'block')::INT) AS d FROM j WHERE host <> '' AND says IS NOT NULL GROUP BY host),
b AS (SELECT 'trust' AS kind, host, 0.15::DOUBLE * t / (SELECT sum(t) FROM h) AS rank FROM h WHERE t > 0 UNION ALL SELECT 'distrust', host, 0.15::DOUBLE * d / (SELECT sum(d) FROM h) FROM h WHERE d > 0),
o AS (SELECT CASE WHEN (SELECT count(*) FROM m) = 0 THEN 1 ELSE greatest(200, (SELECT count(*) FROM (SELECT src FROM m UNION SELECT dst FROM m))) END AS rounds),
r AS (SELECT kind, host, rank, 0 AS k FROM b UNION ALL SELECT kind, host, sum(rank), k FROM (SELECT kind, host, rank, k + 1 AS k FROM b, (SELECT max(k) AS k FROM r), o WHERE k < rounds
  UNION ALL SELECT m.kind, m.dst, r.rank * m.part * 0.85::DOUBLE, r.k + 1 FROM m JOIN r ON r.kind = m.kind AND r.host = m.src, o WHERE r.k < rounds) GROUP BY kind, host, k),
k AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0.0::DOUBLE) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0.0::DOUBLE) AS distrust FROM r WHERE k = (SELECT max(k) FROM r) GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(says, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, round(coalesce(trust, 0), 9) AS trust, round(coalesce(distrust, 0), 9) AS distrust FROM j LEFT JOIN k ON j.host = k.host"""


def _codes_sql(rounds: int = 4) -> str:
    """The vectors' parts, and an assignment and a mean for each round; sums of whole numbers in doubles are exact here."""
    near = "(SELECT r, part, min({{'d': list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x), 'e': b.entry}}) AS m FROM p JOIN b{0} b USING (part) GROUP BY r, part)"
    steps = "".join(
        f""",
a{k} AS MATERIALIZED {near.format(k)},
s{k} AS (SELECT part, entry, i, sum(c)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT part, m.e AS entry, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM a{k} JOIN p USING (r, part)) GROUP BY part, entry, i),
m{k} AS (SELECT part, entry, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS x FROM s{k} GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.x, b{k}.x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
        for k in range(rounds)
    )
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 1024)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, r AS entry, x FROM p WHERE r < 256){steps},
z AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM {near.format(rounds)} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN z USING (r) CROSS JOIN h"""


_TRIE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
f AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
k AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t) CROSS JOIN f),
r AS (SELECT k.c, 0 AS side, pos, x FROM k JOIN t ON t.c = base AND pos < h UNION ALL SELECT k.c, 1, pos, x FROM k JOIN t ON t.c = k.c AND pos >= h),
s AS (SELECT k.c, coalesce(seq, []) AS seq FROM k LEFT JOIN (SELECT c, list(x ORDER BY side, pos) AS seq FROM r GROUP BY c) USING (c)),
m AS (SELECT c, d, seq[1:d] AS node, len(seq) = d AS ended FROM (SELECT c, seq, unnest(range(len(seq) + 1)) AS d FROM s)),
n AS MATERIALIZED (SELECT d, node, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '')) AS ends_sha256,
  (count(*) - 1) * len(regexp_extract_all(coalesce(node[d].t, ''), '[^ 	-
]+')) AS saved FROM m GROUP BY d, node),
p AS MATERIALIZED (SELECT n.*, p.conv_id AS parent FROM n LEFT JOIN n p ON p.d = n.d - 1 AND p.node = n.node[1 : n.d - 1]),
z AS MATERIALIZED (SELECT n.conv_id, n.d, coalesce(k, 0) AS k FROM n LEFT JOIN (SELECT parent, d - 1 AS d, count(*) AS k FROM p WHERE parent IS NOT NULL GROUP BY parent, d) y ON y.parent = n.conv_id AND y.d = n.d),
a AS (SELECT e, node[1:e] AS top, saved, k = 0 AS leaf FROM (SELECT p.*, k, unnest(range(p.d + 1)) AS e FROM p JOIN z ON z.conv_id = p.conv_id AND z.d = p.d)),
q AS (SELECT e, top, sum(leaf::INT) AS n_leaves, sum(saved) AS saved_tokens FROM a GROUP BY e, top)
SELECT p.conv_id, p.d AS depth, parent AS parent_conv_id, n_convs, z.k AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM p JOIN z ON z.conv_id = p.conv_id AND z.d = p.d JOIN q ON q.e = p.d AND q.top = p.node"""


#: Models, packing, tokens and the approximate search have no SQL; tests hold them against brute force or round trips.
#: Line deduplication has none either: comparing all pairs of lines in SQL is too slow on whole tables.
SQL: dict[str, str] = {
    "op3_mixing": _MIX,
    "op7_decontamination": _LEAKS,
    "op8_urls": _urls_sql(),
    "op9_jaccard_join": _classes_sql(75, 5),
    "op11_codes": _codes_sql(),
    "op12_trie": _TRIE,
    "op13_minhash": _classes_sql(80, 4, ", n.doc_id IS NOT DISTINCT FROM coalesce(m.root, n.doc_id) AS kept"),
}
