"""DuckDB SQL for those queries that SQL can express over whole tables: op1, op3 and op9, by brute force.

The other operators are models, file formats, min cuts, tokenizers, rule engines or linear programs; they are tested
against brute force, round trips and held-out accuracy instead.
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"

#: (id, smallest id reached) over the table `pairs` of links in both directions and `nodes` of all ids.
_REACH = """reach(id, root) AS (SELECT id, id FROM nodes UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON r.id = p.a),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)"""

OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), nodes AS (SELECT vec_id AS id FROM v),
g AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
{_REACH}
SELECT id AS vec_id, (SELECT count(*) FROM pairs WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM comp"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents), nodes AS (SELECT doc_id AS id FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT l.doc_id AS a, r.doc_id AS b FROM u l JOIN u r ON l.x = r.x AND l.doc_id < r.doc_id AND 100 * least(l.n, r.n) >= 80 * greatest(l.n, r.n) GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))),
pairs AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), {_REACH}
SELECT id AS doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, id = component_id AS kept FROM comp JOIN s ON s.doc_id = id"""

_WORDS = f"regexp_extract_all({_ASCII_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3 = f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM bw), lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n),
dx AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM dw), hit AS (SELECT doc_id, i, dx.n, item_id FROM dx JOIN win ON dx.n = win.n AND dx.x = win.x),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cover ON cover.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""

ORACLE: dict[str, str] = {"op1_itq_dedup": OP1, "op3_decontamination": OP3, "op9_minhash_dedup": OP9}
