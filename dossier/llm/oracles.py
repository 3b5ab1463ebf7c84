"""SQL that says the same as queries op3, op4, op5 and op9 to op13, for tables of a few thousand documents."""

_WORDS = "list_filter(regexp_split_to_array({}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
# Lower case for A to Z alone.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM meet JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)"""

_ALNUM = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
LEAKS = f"""WITH d AS (SELECT doc_id, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS k, unnest([array_to_string(w[p:p+9], ' ') for p in range(1, greatest(len(w) - 8, 2))]) AS g FROM i WHERE len(w) > 0),
h AS (SELECT doc_id, p, k, unnest(items) AS item FROM
 (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest([array_to_string(w[p:p+k-1], ' ') for p in range(1, len(w) - k + 2)]) AS t FROM d, (SELECT DISTINCT k FROM g)) JOIN (SELECT g, list(item) AS items FROM g GROUP BY g) ON t = g),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

def _checks() -> list[int]:
    """Remainders of all bytes, of the reversed polynomial of CRC-32."""
    out = list(range(256))
    for _ in range(8):
        out = [(v >> 1) ^ (0xEDB88320 if v & 1 else 0) for v in out]
    return out


SHARDS = f"""WITH k AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
c AS (SELECT doc_id, hex(encode(text)) AS x FROM k),
s AS (SELECT doc_id, xor(list_reduce([CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) for i in range(length(x) // 2)], lambda a, b: xor(a >> 8, {_checks()}[xor(a & 255, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc FROM c),
o AS (SELECT *, sum(size) OVER (ORDER BY h, doc_id) - size AS below, sum(size) OVER () AS total FROM k),
p AS (SELECT doc_id, CAST(size AS BIGINT) AS size, h, CAST(least(15, 16 * (2 * below + size) // (2 * total)) AS INTEGER) AS shard FROM o)
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p JOIN s USING (doc_id)"""

BYTES = """WITH x AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT r, unnest(range(length(x) // 2 - 199)) AS p, unnest([md5(substr(x, 2 * i + 1, 400)) for i in range(length(x) // 2 - 199)]) AS m FROM x WHERE length(x) >= 400),
g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY m) AS n FROM s) WHERE n > 1),
f AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
v AS (SELECT r, min(p) AS a, max(p) + 200 AS b FROM f GROUP BY r, k),
z AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM v GROUP BY r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(unhex(CASE WHEN a IS NULL THEN x ELSE array_to_string([substr(x, 2 * CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END + 1, 2 * (CASE WHEN i > len(a) THEN length(x) // 2 ELSE a[i] END - CASE WHEN i = 1 THEN 0 ELSE b[i - 1] END)) for i in range(1, len(a) + 2)], '') END)) AS kept_sha256
FROM x LEFT JOIN z USING (r)"""

PASSAGES = f"""WITH x AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, unnest([md5(array_to_string(w[i:i+49], ' ')) for i in range(1, len(w) - 48)]) AS m FROM x WHERE len(w) >= 50),
g AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY m) AS first FROM s) WHERE first < doc_id),
c AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(p, p + 50)) AS i FROM g) GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM x LEFT JOIN c USING (doc_id)),
e AS (SELECT doc_id, string_agg(v, ' ' ORDER BY i) AS kept FROM (SELECT k.doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS i FROM k) u WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS j FROM c) y WHERE y.doc_id = u.doc_id AND y.j = u.i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN e USING (doc_id)"""


def _hash(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT)"


# o: sources in order; q: those that stop at twice their words come first, by words for each unit of weight.
MIXED = f"""WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, {_hash("coalesce(CAST(doc_id AS VARCHAR), '') || '/' || coalesce(text, '')")} AS h FROM documents),
o AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][k % 3 + 1] AS w, CAST(sum(words) OVER () AS BIGINT) AS total FROM o),
q AS (SELECT *, coalesce(sum(2 * words) OVER (ORDER BY words / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (ORDER BY words / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above FROM w),
c AS (SELECT *, w * (3 * total - 2 * below) > 4 * words * above AS stops FROM q),
g AS (SELECT *, CASE WHEN stops THEN CAST(2 * words AS DOUBLE) ELSE CAST(w * (3 * total - 2 * coalesce(sum(2 * words) FILTER (WHERE stops) OVER (), 0)) AS DOUBLE) / (2 * sum(w) FILTER (WHERE NOT stops) OVER ()) END AS target, (words + 63) // 64 AS blocks FROM c),
f AS (SELECT *, CAST(floor(target / greatest(1, words)) AS BIGINT) AS whole FROM g),
p AS (SELECT *, whole * blocks + least(blocks, CAST(floor((target - whole * words) / 64 + 0.5) AS BIGINT)) AS slots FROM f),
i AS (SELECT *, CAST(sum(slots) OVER (ORDER BY k) - slots AS HUGEINT) * 1152921504606846976 // sum(slots) OVER () AS low, CAST(sum(slots) OVER (ORDER BY k) AS HUGEINT) * 1152921504606846976 // sum(slots) OVER () AS high FROM p WHERE slots > 0),
x AS (SELECT pos, {_hash("'mix/slot/' || pos")} AS u FROM (SELECT unnest(range((SELECT CAST(sum(slots) AS BIGINT) FROM p))) AS pos)),
n AS (SELECT pos, k, row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS number FROM x JOIN i ON u >= low AND u < high),
t AS (SELECT p.k, blocks, slots, coalesce(got, 0) AS got, greatest(0, coalesce(got, 0) - slots) AS over, greatest(0, slots - coalesce(got, 0)) AS short FROM p LEFT JOIN (SELECT k, count(*) AS got FROM n GROUP BY k) y ON y.k = p.k),
m AS (SELECT *, sum(over) OVER (ORDER BY k) - over AS over_from, sum(short) OVER (ORDER BY k) - short AS short_from FROM t),
spare AS (SELECT number - slots + over_from AS spare FROM n JOIN m USING (k) WHERE number >= slots),
a AS (SELECT k, number, blocks FROM n JOIN m USING (k) WHERE number < slots UNION ALL SELECT k, got + spare - short_from, blocks FROM spare JOIN m ON spare >= short_from AND spare < short_from + short),
e AS (SELECT k, CAST(number // blocks AS INTEGER) AS pass, CAST(number % blocks AS BIGINT) AS pos, CAST(blocks AS BIGINT) AS blocks FROM a),
b AS (SELECT k, list_reduce(list_concat([pos], range(16)), lambda z, r: CASE WHEN ascii(md5('mix/bit/' || k || '/' || pass || '/' || r || '/' || greatest(z, ({_hash("'mix/key/' || k || '/' || pass || '/' || r")} % blocks - z + blocks) % blocks))) % 2 = 1
 THEN ({_hash("'mix/key/' || k || '/' || pass || '/' || r")} % blocks - z + blocks) % blocks ELSE z END) AS block FROM e),
times AS (SELECT k, block, count(*) AS times FROM b GROUP BY k, block),
s AS (SELECT row_number() OVER () AS r, doc_id, size, k, sum(size) OVER (PARTITION BY k ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS start FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
pieces AS (SELECT r, k, start, size, unnest(range(CAST(start // 64 AS BIGINT), CAST((start + size - 1) // 64 + 1 AS BIGINT))) AS block FROM s WHERE size > 0),
taken AS (SELECT r, sum(times * (least(start + size, 64 * block + 64) - greatest(start, 64 * block))) AS taken FROM pieces JOIN times USING (k, block) GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, words AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM s JOIN g USING (k) LEFT JOIN taken USING (r)"""


def _codes(rounds: int = 4) -> str:
    """Parts of vectors (v), codebooks after each round (e0, e1, ...), and the nearest entries (a0, a1, ...)."""
    near = """a{k} AS MATERIALIZED (SELECT r, part, arg_min(i, (d, i)) AS i, min(d) AS d FROM (SELECT r, v.part, i, list_inner_product(x, x) - 2 * list_inner_product(x, y) + list_inner_product(y, y) AS d FROM v JOIN e{k} ON v.part = e{k}.part) GROUP BY r, part)"""
    means = """m{k} AS (SELECT part, i, j, floor(sum(z) / count(*)) AS z FROM (SELECT part, i, unnest(x) AS z, unnest(range(len(x))) AS j FROM a{k} JOIN v USING (r, part)) GROUP BY ALL),
e{n} AS MATERIALIZED (SELECT part, i, coalesce(n.y, o.y) AS y FROM e{k} o LEFT JOIN (SELECT part, i, list(z ORDER BY j) AS y FROM m{k} GROUP BY part, i) n USING (part, i))"""
    steps = ",\n".join(f"{near.format(k=k)},\n{means.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, part, x[part * len(x) // 4 + 1:(part + 1) * len(x) // 4] AS x FROM k, range(4) AS p(part)),
e0 AS MATERIALIZED (SELECT part, r AS i, x AS y FROM v WHERE r < 256),
{steps},
{near.format(k=rounds)},
s AS (SELECT sha256(array_to_string(list(CAST(y AS BIGINT[]) ORDER BY part, i).flatten(), ',')) AS codebooks_sha256 FROM e{rounds}),
c AS (SELECT r, string_agg(printf('%02x', CAST(i AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), s"""


CODES = _codes()


DIVERGENCE = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS t FROM d), g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT lang, t FROM t GROUP BY lang, t HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, t, count(*) AS n FROM t JOIN k USING (lang, t) GROUP BY ALL),
x AS (SELECT lang, source, t, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, t)),
p AS (SELECT lang, source, t, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM x),
y AS (SELECT lang, t, sum(n) AS n FROM x GROUP BY lang, t),
q AS (SELECT lang, t, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM y),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
z AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT lang, source, 'term', t, (p - q) * (p - q) // q FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM z)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 200"""
