"""DuckDB SQL that gives the rows of the operators which SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def mixing(weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 20, rounds: int = 4) -> str:
    """Targets, whole copies, and rounds that take documents by random odds over inclusion odds while they fit."""
    parts = [
        f"d AS (SELECT doc_id, source AS src, {WORDS}::BIGINT AS size FROM documents)",
        "s AS (SELECT src, sum(size)::BIGINT AS ss FROM d GROUP BY 1)",
        f"w AS (SELECT *, ({list(weights)})[(row_number() OVER (ORDER BY src ASC NULLS LAST) - 1) % {len(weights)} + 1]::DOUBLE AS w, ss * {cap}::DOUBLE AS c, sum(ss) OVER () AS every FROM s)",
        "l AS (SELECT *, (every - coalesce(sum(c) OVER (ORDER BY c / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (ORDER BY c / w, src NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w)",
        "t AS (SELECT src, ss, least(c, max(lv) OVER () * w) AS target FROM l)",
        "g AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss) ELSE 0 END::BIGINT AS whole FROM t)",
        "h AS (SELECT *, greatest(0.0, target - whole * ss) AS room FROM g)",
        "taken0 AS (SELECT *, 0 AS extra FROM d)",
        "left0 AS (SELECT src, room FROM h)",
    ]
    for k in range(rounds):
        u = f"((('0x' || substr(md5('{seed + k}:' || coalesce(doc_id::VARCHAR, '-') || ':' || size), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
        parts += [
            f"open{k} AS (SELECT x.*, y.room, {u} AS u FROM taken{k} x JOIN left{k} y ON x.src IS NOT DISTINCT FROM y.src WHERE extra = 0 AND size > 0 AND size <= room)",
            f"q{k} AS (SELECT *, (sum(size) OVER (PARTITION BY src))::DOUBLE AS pool, (sum(size::HUGEINT * size) OVER (PARTITION BY src))::DOUBLE AS sq, count(*) OVER (PARTITION BY src) AS n FROM open{k})",
            f"p{k} AS (SELECT *, least(room / (pool - sq / room / 2) * (CASE WHEN n > 1 THEN 1 - size / room / 2 ELSE 1.0::DOUBLE END), 1 - 1e-9::DOUBLE) AS p FROM q{k})",
            f"r{k} AS (SELECT *, sum(size) OVER (PARTITION BY src ORDER BY (u / (1 - u)) / (p / (1 - p)), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto FROM p{k})",
            f"taken{k + 1} AS (SELECT doc_id, src, size, CASE WHEN doc_id IN (SELECT doc_id FROM r{k} WHERE upto <= room) THEN 1 ELSE extra END AS extra FROM taken{k})",
            f"left{k + 1} AS (SELECT h.src, h.room - coalesce((SELECT sum(size) FROM taken{k + 1} x WHERE x.extra = 1 AND x.src IS NOT DISTINCT FROM h.src), 0) AS room FROM h)",
        ]
    return f"""WITH {', '.join(parts)} SELECT doc_id, size, ss AS source_size, target, ((whole + extra) * size)::BIGINT AS taken, (whole + extra)::INT AS copies FROM taken{rounds} x JOIN h ON x.src IS NOT DISTINCT FROM h.src"""


def decontamination(masks: tuple[str, ...] = ("1110010111", "11011001011"), more: tuple[str, ...] = ("1111011", "1110111", "1110000100011"), reach: int = 5, min_overlap: int = 13, min_equal: float = 0.8, min_exact: int = 5) -> str:
    """Documents and items with equal tokens under a mask; in the alignment of each hit, some span around it must have enough equal tokens."""
    span, short, most = max(map(len, masks)), min(map(len, (*masks, *more))), 2 * min_overlap - 1

    def seeds(table: str, k: int, mask: str) -> str:
        at = [i for i, bit in enumerate(mask) if bit == "1"]
        key = " || chr(31) || ".join(f"w[i + {j + 1}]" for j in at)
        return f"SELECT id, w, i, {k} AS m, {key} AS key FROM (SELECT id, w, unnest(range(0, len(w) - {short - 1})) AS i FROM {table}) WHERE i + {len(mask) - 1} < len(w)"

    tokens = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+')"
    side = lambda table: " UNION ALL ".join(seeds(table, k, m) for k, m in enumerate((*masks, *more)))
    equal = lambda lo, hi: f"len(list_filter(range({lo}, {hi}), lambda k: dw[k + i - j + 1] = iw[k + 1]))"
    same = f"list_transform(range(greatest(la, j - {most - 1}), least(ha, j + {most})), lambda k: (dw[k + i - j + 1] = iw[k + 1])::INT)"
    dense = f"len(list_filter(range({min_overlap}, least({most}, len(e)) + 1), lambda n: len(list_filter(range(0, len(e) - n + 1), lambda s: list_sum(e[s + 1 : s + n]) >= n * {min_equal}::DOUBLE)) > 0)) > 0"
    return f"""WITH docs AS (SELECT doc_id AS id, {tokens} AS w FROM documents), items AS (SELECT DISTINCT item_id AS id, {tokens} AS w FROM benchmark),
a AS ({side('docs')}), b AS ({side(f'(SELECT * FROM items WHERE len(w) >= {min_overlap})')}), hit AS (SELECT a.id AS doc_id, b.id AS item_id, a.w AS dw, b.w AS iw, a.i AS i, b.i AS j, a.m AS mask FROM a JOIN b ON a.m = b.m AND a.key = b.key),
lim AS (SELECT *, greatest(0, j - i) AS la, least(len(iw), len(dw) - i + j) AS ha FROM hit), win AS (SELECT *, greatest(la, j - {reach}) AS lo, least(ha, j + {span + reach}) AS hi, {same} AS e FROM lim),
ok AS (SELECT doc_id, item_id, {equal('la', 'ha')} AS m, ha - la AS o, (mask < {len(masks)} AND hi - lo >= {min_overlap} AND {equal('lo', 'hi')} >= (hi - lo) * {min_equal}::DOUBLE)::INT AS whole FROM win WHERE {dense}),
e AS (SELECT d.id AS doc_id, i.id AS item_id, len(i.w) AS m, len(i.w) AS o, 1 AS whole FROM (SELECT id, w, unnest(range(0, len(w) - {min_exact - 1})) AS p FROM docs) d JOIN items i ON len(i.w) BETWEEN {min_exact} AND {min_overlap - 1} AND d.w[p + 1] = i.w[1] AND d.w[p + 1 : p + len(i.w)] = i.w)
SELECT doc_id, item_id, arg_max(m, (m, o))::BIGINT AS matched, arg_max(o, (m, o))::BIGINT AS overlap, sum(whole)::BIGINT AS hits FROM (FROM ok UNION ALL FROM e) GROUP BY 1, 2"""


def ngram_jaccard(n: int = 5, threshold: float = 0.8) -> str:
    """Pairs of different n-gram sets at the threshold, counted with copies, and the smallest id of each component."""
    gram = " || ' ' || ".join(f"w[i + {k + 1}]" for k in range(n))
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, {gram} AS t FROM (SELECT doc_id, w, unnest(range(0, len(w) - {n - 1})) AS i FROM d WHERE len(w) >= {n}) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND {n - 1}),
k AS (SELECT doc_id, count(*) AS c, md5(string_agg(md5(t), '' ORDER BY md5(t))) AS h FROM g GROUP BY 1),
s AS (SELECT h, min(doc_id) AS rep, count(*) AS copies, min(c) AS c FROM k GROUP BY 1), sg AS (SELECT rep, t FROM g JOIN s ON g.doc_id = s.rep),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS common FROM sg x JOIN sg y ON x.t = y.t AND x.rep <> y.rep GROUP BY 1, 2),
e AS (SELECT a, b, y.copies FROM p JOIN s x ON x.rep = a JOIN s y ON y.rep = b WHERE common >= {threshold} * (x.c + y.c - common) - 1e-9),
r AS (SELECT rep AS node, rep AS root FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY 1), l AS (SELECT a, sum(copies) AS n FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(l.n + s.copies - 1, s.copies - 1, 0)::BIGINT AS n_links FROM d LEFT JOIN k USING (doc_id) LEFT JOIN s ON s.h = k.h LEFT JOIN c ON c.node = s.rep LEFT JOIN l ON l.a = s.rep"""


def substrings(length: int = 50) -> str:
    """Windows of each text in hexadecimal (cut from pieces of it), the least id of each, and the bytes that later windows cover."""
    return f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), n AS (SELECT *, length(x) // 2 AS n FROM d),
z AS (SELECT doc_id, pos, n, substr(x, 2 * pos + 1, {2 * (255 + length)}) AS y FROM (SELECT doc_id, x, n, unnest(range(0, n - {length - 1}, 256)) AS pos FROM n)),
v AS (SELECT doc_id, pos + i AS s, hash(substr(y, 2 * i + 1, {2 * length})) AS h1, hash('a' || substr(y, 2 * i + 1, {2 * length})) AS h2 FROM (SELECT doc_id, pos, y, unnest(range(0, least(256, n - {length - 1} - pos))) AS i FROM z)),
f AS (SELECT h1, h2, min(doc_id) AS m FROM v GROUP BY 1, 2 HAVING min(doc_id) < max(doc_id)), g AS (SELECT v.doc_id, v.s FROM v JOIN f USING (h1, h2) WHERE v.doc_id > f.m),
b AS (SELECT doc_id, s, (s > coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -{length + 1}) + {length})::INT AS fresh FROM g),
r AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM b), q AS (SELECT doc_id, run, min(s) AS lo, max(s) + {length} AS hi FROM r GROUP BY 1, 2),
k AS (SELECT doc_id, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS a, lo AS z FROM q UNION ALL SELECT n.doc_id, coalesce(max(hi), 0), any_value(n) FROM n LEFT JOIN q USING (doc_id) GROUP BY n.doc_id),
t AS (SELECT doc_id, count(*) AS spans, sum(hi - lo) AS gone FROM q GROUP BY 1),
o AS (SELECT k.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS kept FROM k JOIN d USING (doc_id) GROUP BY 1)
SELECT n.doc_id, n.n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)"""


def sharding(shards: int = 24) -> str:
    """Running sums of sizes in order of the id; the checksum goes byte by byte, with a table made from its polynomial."""
    table = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    return f"""WITH tab AS (SELECT {table} AS t), d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
z AS (SELECT doc_id, pos, substr(x, 2 * pos + 1, 512) AS y FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 256)) AS pos FROM d)),
b AS (SELECT doc_id, flatten(list(list_transform(range(length(y) // 2), lambda i: ('0x' || substr(y, 2 * i + 1, 2))::BIGINT) ORDER BY pos)) AS bytes FROM z GROUP BY 1),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b, tab),
s AS (SELECT d.doc_id, length(x) // 2 + 8 AS size, coalesce(crc, 0) AS crc FROM d LEFT JOIN c USING (doc_id)),
u AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, crc ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS every FROM s),
p AS (SELECT *, ((2 * upto - size) * {shards} // (2 * every))::INT AS shard FROM u)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id, size, crc) - 1)::BIGINT AS slot, NULL::INT AS grown_shard FROM p"""


def search(k: int = 50) -> str:
    """Statistics of all terms, the integer weight and impact of each posting an item asks for, and the first rows by score and id."""
    terms = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {terms} AS t FROM documents), s AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS nd, sum(len(t))::BIGINT AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark), p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS t FROM d) GROUP BY 1, 2, 3),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY t, nd),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY 1, 2)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= {k}"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain assignment of all parts to all entries, in each round."""
    floor = "((s - ((s % n) + n) % n) // n)::BIGINT"
    far = "list_sum(list_transform(list_zip(p.q, e.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts_ = [
        "k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS (SELECT vec_id, label, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS q FROM (SELECT *, unnest(range({parts})) AS part FROM k))",
        f"o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries})",
        "e0 AS (SELECT part, entry, q FROM p JOIN o USING (vec_id))",
    ]
    for r in range(rounds + 1):
        parts_.append(f"a{r} AS (SELECT vec_id, any_value(label) AS label, part, any_value(q) AS q, min(struct_pack(d := d, entry := entry)) AS best FROM (SELECT p.*, e.entry, {far} AS d FROM p JOIN e{r} e USING (part)) GROUP BY vec_id, part)")
        if r < rounds:
            parts_ += [
                f"s{r} AS (SELECT part, entry, list({floor} ORDER BY i) AS q FROM (SELECT part, best.entry AS entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, best, unnest(q) AS x, unnest(range(len(q))) AS i FROM a{r}) GROUP BY 1, 2, 3) GROUP BY 1, 2)",
                f"e{r + 1} AS (SELECT part, entry, coalesce(s{r}.q, e{r}.q) AS q FROM e{r} LEFT JOIN s{r} USING (part, entry))",
            ]
    return f"""WITH {', '.join(parts_)}, c AS (SELECT vec_id, any_value(label) AS label, string_agg(lpad(lower(hex(best.entry)), 2, '0'), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
b AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c, b"""
