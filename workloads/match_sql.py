"""The SQL that the matching core is checked against: tokens, pair rules, the grouping walk, products and their names.

The catalog is part, as match_views writes it. The walks are recursions that carry their state in lists, one step per pair or shelf.
"""

from __future__ import annotations

from . import match_views as M

L = M.LEXICON
DROPPED = list(L.neutral + L.genders)
SHORT_SKIPPED = list(L.genders + L.neutral + L.identity_noise + L.short_names)
STORE_DROPPED = list(L.store_units + L.audience + L.store_filler)
LONG_FILLER = [f for f in L.store_filler if len(f) >= 5]
CLOSE = "levenshtein({a}, {b}) / greatest(len({a}), len({b})) <= 0.35"

#: One row per listing with everything the rules and identities read.
LISTINGS = M.TOKENS_SQL + rf""",
vec0 AS (SELECT t3.*, CAST(e.embedding AS DOUBLE[]) AS v FROM t3 JOIN embeddings e ON e.vec_id = t3.listing_id % (SELECT count(*) FROM embeddings)),
said AS (
  SELECT *, regexp_extract_all(lower(regexp_replace(regexp_replace(name, '\((?:M|H|U)\)', ' ', 'g'),
      '\b(?:eau\s+(?:de|du|d|the)\s+(?:parfum|perfum|toilette|cologne)|extrait\s+de\s+parfum|edp|edt|edc)\b', ' ', 'gi')), '[a-z]+|\d+(?:[.,]\d+)?') AS said,
    regexp_extract_all(lower(coalesce(brand, '')), '[a-z]+|\d+(?:[.,]\d+)?') AS said_brand,
    regexp_extract_all(regexp_replace(coded, '\((?:m|h|u)\)', ' ', 'g'), '[a-z]+') AS short_words FROM t3),
named AS (
  SELECT * EXCLUDE (said), list_sort(list_filter(said, lambda w, i: NOT (list_contains(said_brand, w) AND list_position(said, w) = i)
      AND NOT list_contains({STORE_DROPPED}, w) AND NOT (len(w) >= 5 AND NOT list_contains({list(L.not_filler_typos)}, w)
          AND len(list_filter({LONG_FILLER}, lambda f: {CLOSE.format(a='w', b='f')})) > 0)
      AND NOT coalesce(volume_ml > 0 AND replace(w, ',', '.') IN (CAST(volume_ml AS VARCHAR), CAST(volume_ml AS VARCHAR) || '.0'), false))) AS store_words,
    list_sort(list_concat(
      list_filter(coded_words, lambda w: (len(w) > 2 OR w = 'x') AND NOT list_contains({DROPPED}, w) AND NOT list_contains(brand_words, w)),
      list_filter(short_words, lambda w: len(w) <= 2 AND NOT list_contains({SHORT_SKIPPED}, w) AND NOT list_contains(brand_words, w)))) AS identity_core,
    list_sort(editions) AS edition_list, CASE WHEN is_set THEN 'travel_set' ELSE 'full_bottle' END AS presentation FROM said),
keyed AS (
  SELECT *, concat_ws('|', brand_key, array_to_string(identity_core, ' '), coalesce(coded_gender, ''), array_to_string(edition_list, ' ')) AS identity FROM named),
tok AS (
  SELECT *, CASE WHEN volume_ml > 0 THEN concat_ws('#', identity, coalesce(concentration, ''), CAST(volume_ml AS VARCHAR), presentation) END AS listing_key,
    len(list_filter(words, lambda w: len(w) > 2 AND w NOT IN ('men', 'women', 'for', 'set', 'edp', 'edt', 'eau', 'parfum', 'new')
                    AND NOT list_contains(brand_words, w))) = 0 AND len(editions) = 0 AS is_generic FROM keyed),
sigs AS (SELECT listing_id, store, CASE WHEN listing_key IS NOT NULL THEN listing_key || '§' || array_to_string(store_words, ' ') END AS sig FROM tok)"""


def _split_lines(name: str, gender: str) -> str:
    """Lines sold in both genders, or with and without one on a store's shelf."""
    return f"""
{name} AS (
  SELECT array_to_string(core, ' ') AS line FROM tok GROUP BY 1 HAVING count(DISTINCT {gender}) > 1
  UNION
  SELECT line FROM (SELECT array_to_string(core, ' ') AS line, store, volume_ml, concentration, {gender} AS g FROM tok WHERE NOT is_set AND volume_ml > 0)
  GROUP BY line, store, volume_ml, concentration HAVING count(*) > count(g) AND count(g) > 0)"""


SAME_BRAND = """CASE WHEN least(len(x), len(y)) <= 3 THEN x = y
  ELSE contains(x, y) OR contains(y, x) OR levenshtein(x, y) / greatest(len(x), len(y)) <= 0.35 END"""

#: Words of a that neither brand says, spelling aside.
_OWN = "list_filter({s}.core, lambda w: len(list_filter(list_concat(x.brand_words, y.brand_words), lambda b: w = b OR (len(w) > 3 AND " + CLOSE.format(a="w", b="b") + "))) = 0)"
#: The free words near to one, nearest first.
_NEAR = "list_sort(list_transform(list_filter(string_split(split_part(s, ';', 2), ' '), lambda o: o <> '' AND " + CLOSE.format(a="w", b="o") + \
    "), lambda o: {'d': levenshtein(w, o) / greatest(len(w), len(o)), 'o': o}))"


def decided(labelled: bool) -> str:
    """decisions (a, b, similarity, kind, reason) of all candidate pairs, and of labelled ones by their labels first."""
    wanted = f""",
{M.LABELS_SQL.strip()},
human AS (SELECT CASE WHEN (p.store, p.listing_id) < (q.store, q.listing_id) THEN p.listing_id ELSE q.listing_id END AS a,
            CASE WHEN (p.store, p.listing_id) < (q.store, q.listing_id) THEN q.listing_id ELSE p.listing_id END AS b, l.label, round(list_dot_product(p.v, q.v), 6) AS similarity
          FROM label_pairs l JOIN vec0 p ON p.listing_url = l.url_a JOIN vec0 q ON q.listing_url = l.url_b),
asked AS (SELECT a, b, similarity, label FROM pairs LEFT JOIN (SELECT a, b, label FROM human) USING (a, b)
          UNION ALL SELECT a, b, similarity, label FROM human WHERE (a, b) NOT IN (SELECT (a, b) FROM pairs))"""
    plain = ", asked AS (SELECT a, b, similarity, CAST(NULL AS VARCHAR) AS label FROM pairs)"
    return LISTINGS + f""",
scored AS (
  SELECT * FROM (SELECT a.listing_id AS id, a.store AS store, b.listing_id AS other_id, b.store AS other_store,
         a.brand_key AS x, b.brand_key AS y, round(list_dot_product(a.v, b.v), 6) AS similarity
  FROM vec0 a JOIN vec0 b ON a.store <> b.store) WHERE {SAME_BRAND}),
near AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, other_store ORDER BY similarity DESC, other_id) AS rank FROM scored) WHERE rank <= 5),
pairs AS (
  SELECT DISTINCT CASE WHEN (store, id) < (other_store, other_id) THEN id ELSE other_id END AS a,
         CASE WHEN (store, id) < (other_store, other_id) THEN other_id ELSE id END AS b, similarity FROM near)""" + (wanted if labelled else plain) + f""",
{_split_lines('lines', 'gender')}, {_split_lines('coded_lines', 'coded_gender')},
flagged AS (SELECT *, array_to_string(core, ' ') IN (SELECT line FROM lines) AS split, array_to_string(core, ' ') IN (SELECT line FROM coded_lines) AS coded_split FROM tok),
sides AS (
  SELECT asked.*, x.store AS store_a, y.store AS store_b,
    CASE WHEN x.volume_ml <> y.volume_ml THEN 'volume' WHEN x.concentration <> y.concentration THEN 'concentration' WHEN x.gender <> y.gender THEN 'gender'
      WHEN (x.gender IS NULL) <> (y.gender IS NULL) AND x.core = y.core AND x.split THEN 'gender'
      WHEN x.is_set <> y.is_set THEN 'presentation' WHEN x.is_generic <> y.is_generic THEN 'generic'
      WHEN x.exact_variants <> y.exact_variants OR x.editions <> y.editions THEN 'variant' END AS settled,
    coalesce(CASE WHEN (x.gender IS NULL) <> (y.gender IS NULL) AND (CASE WHEN x.gender IS NOT NULL THEN y.coded_gender ELSE x.coded_gender END) IS NULL
        THEN (CASE WHEN x.gender IS NOT NULL THEN x.coded_split ELSE y.coded_split END)
      WHEN NOT ((x.coded_gender IS NOT NULL AND x.gender IS NULL) OR (y.coded_gender IS NOT NULL AND y.gender IS NULL)) THEN false
      WHEN x.coded_gender IS NOT NULL AND y.coded_gender IS NOT NULL THEN x.coded_gender <> y.coded_gender
      WHEN x.coded_gender IS NOT NULL THEN x.coded_split ELSE y.coded_split END, false) AS marker,
    coalesce(x.volume_ml > 0 AND y.volume_ml > 0, false) AS sized, x.is_generic AND y.is_generic AS both_generic,
    list_sort(list_filter({_OWN.format(s='x')}, lambda w: NOT list_contains({_OWN.format(s='y')}, w))) AS oa,
    list_sort(list_filter({_OWN.format(s='y')}, lambda w: NOT list_contains({_OWN.format(s='x')}, w))) AS ob
  FROM asked JOIN flagged x ON x.listing_id = a JOIN flagged y ON y.listing_id = b),
paired AS (
  SELECT *, list_reduce(oa, lambda s, w: CASE WHEN len({_NEAR}) = 0 THEN CAST(CAST(split_part(s, ';', 1) AS INTEGER) + 1 AS VARCHAR) || ';' || split_part(s, ';', 2)
      ELSE split_part(s, ';', 1) || ';' || array_to_string(list_filter(string_split(split_part(s, ';', 2), ' '), lambda o: o <> ({_NEAR})[1].o), ' ') END,
      '0;' || array_to_string(ob, ' ')) AS matched FROM sides),
compared AS (
  SELECT *, len(oa) > 0 AND len(ob) > 0 AND split_part(matched, ';', 1) <> '0' AND split_part(matched, ';', 2) <> '' AS other_name,
    CASE WHEN len(oa) = 0 AND len(ob) = 0 THEN true WHEN len(oa) = 0 OR len(ob) = 0 THEN false
      ELSE len(list_filter(oa, lambda w: len(list_filter(ob, lambda o: {CLOSE.format(a='w', b='o')})) = 0)) = 0
       AND len(list_filter(ob, lambda w: len(list_filter(oa, lambda o: {CLOSE.format(a='w', b='o')})) = 0)) = 0 END AS same_name FROM paired),
reasoned AS (
  SELECT *, CASE WHEN label IS NOT NULL THEN 'human_' || label WHEN settled IS NOT NULL THEN settled WHEN other_name THEN 'name' WHEN marker THEN 'gender_marker'
    WHEN NOT same_name THEN 'extra_words' WHEN NOT sized THEN 'unknown_volume' WHEN both_generic THEN 'generic_pair' ELSE 'same_name' END AS reason FROM compared),
decisions AS (
  SELECT a, b, store_a, store_b, similarity, CASE WHEN reason IN ('human_same', 'same_name') THEN 'auto'
    WHEN reason = 'human_different' OR label IS NULL AND (settled IS NOT NULL OR reason = 'name') THEN 'veto' ELSE 'review' END AS kind, reason FROM reasoned)"""


#: The walk over accepted pairs, component by component: state is each node's group, store, signature and vetoed nodes.
WALK = """,
autos AS (SELECT a, b, similarity, store_a, store_b FROM decisions WHERE kind = 'auto'),
ends AS (SELECT a AS n, b AS o FROM autos UNION SELECT b, a FROM autos UNION SELECT a, a FROM autos UNION SELECT b, b FROM autos),
reach AS (SELECT n, n AS o FROM ends UNION SELECT reach.n, ends.o FROM reach JOIN ends ON ends.n = reach.o),
comp AS (SELECT n, min(o) AS c FROM reach GROUP BY n),
vetoes AS (SELECT n, list(o) AS v FROM (SELECT a AS n, b AS o FROM decisions WHERE kind = 'veto' UNION ALL SELECT b, a FROM decisions WHERE kind = 'veto') GROUP BY n),
start AS (SELECT c, list({'n': comp.n, 'g': comp.n, 's': store, 'sig': sig, 'v': coalesce(v, [])}) AS nodes FROM comp JOIN sigs ON listing_id = comp.n LEFT JOIN vetoes ON vetoes.n = comp.n GROUP BY c),
ordered AS (SELECT autos.*, c, row_number() OVER (PARTITION BY c ORDER BY similarity DESC, store_a, a, store_b, b) AS i FROM autos JOIN comp ON comp.n = a),
walk AS (
  SELECT c, 0 AS i, nodes, CAST(NULL AS BOOLEAN) AS ok FROM start
  UNION ALL
  SELECT c, i, CASE WHEN ok AND ga <> gb THEN list_transform(nodes, lambda z: {'n': z.n, 'g': CASE WHEN z.g IN (ga, gb) THEN least(ga, gb) ELSE z.g END, 's': z.s, 'sig': z.sig, 'v': z.v})
    ELSE nodes END, ok
  FROM (SELECT *, ga = gb OR len(list_filter(list_filter(nodes, lambda z: z.g = ga), lambda p: len(list_filter(nodes, lambda q: q.g = gb
          AND (p.s = q.s AND (p.sig IS NULL OR q.sig IS NULL OR p.sig <> q.sig) OR list_contains(p.v, q.n)))) > 0)) = 0 AS ok
        FROM (SELECT o.c, o.i, w.nodes, list_filter(w.nodes, lambda z: z.n = o.a)[1].g AS ga, list_filter(w.nodes, lambda z: z.n = o.b)[1].g AS gb
              FROM walk w JOIN ordered o ON o.c = w.c AND o.i = w.i + 1))),
last_state AS (SELECT c, arg_max(nodes, i) AS nodes FROM walk GROUP BY c),
accepted AS (SELECT o.a, o.b, o.store_a, o.store_b, o.similarity, list_filter(l.nodes, lambda z: z.n = o.a)[1].g AS group_id
             FROM ordered o JOIN walk w ON w.c = o.c AND w.i = o.i AND w.ok JOIN last_state l ON l.c = o.c),
grouped AS (SELECT listing_id, group_id, max(similarity) AS confidence FROM (SELECT a AS listing_id, group_id, similarity FROM accepted
            UNION ALL SELECT b, group_id, similarity FROM accepted) GROUP BY 1, 2)"""

REVIEWS = WALK + """,
open_pairs AS (SELECT * FROM decisions WHERE kind = 'review'),
open_ends AS (SELECT a AS listing_id, * FROM open_pairs UNION ALL SELECT b AS listing_id, * FROM open_pairs),
reviews AS (SELECT DISTINCT a, b, similarity, reason FROM (
  SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY similarity DESC, store_a, a, store_b, b, reason) AS rn FROM open_ends
  WHERE listing_id NOT IN (SELECT listing_id FROM grouped)) WHERE rn = 1)"""

#: Groups with their keys; first fit of the distinct shelves of groups that share one; the words that tell the parts apart.
PRODUCTS = WALK + """,
best_pair AS (SELECT group_id, min((-similarity, store_a, a, store_b, b)) AS p FROM accepted GROUP BY 1),
members AS (
  SELECT t.*, coalesce(g.group_id, t.listing_id) AS group_id, g.confidence,
    CASE WHEN g.group_id IS NULL THEN (1, 0.0, t.store, t.listing_id, t.listing_id) ELSE (0, p[1], p[2], p[3], p[5]) END AS place
  FROM tok t LEFT JOIN grouped g ON g.listing_id = t.listing_id LEFT JOIN best_pair ON best_pair.group_id = g.group_id),
group_rows AS (
  SELECT group_id, min(place) AS place, arg_min(volume_ml, (store, listing_id)) FILTER (WHERE volume_ml > 0) AS volume_ml,
    arg_min(concentration, (store, listing_id)) FILTER (WHERE concentration <> '') AS concentration,
    arg_min({'i': identity, 'k': brand_key, 'c': identity_core, 'g': coded_gender, 'e': edition_list, 'p': presentation}, (store, listing_id)) AS head FROM members GROUP BY group_id),
group_keys AS (
  SELECT *, CASE WHEN volume_ml > 0 THEN concat_ws('#', head.i, coalesce(concentration, ''), CAST(volume_ml AS VARCHAR), head.p) END AS product_key FROM group_rows),
crowded AS (SELECT * FROM group_keys WHERE product_key IN (SELECT product_key FROM group_keys WHERE product_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)),
shelf_rows AS (SELECT product_key, group_id, m.store, max(array_to_string(m.store_words, ' ')) AS words, count(*) AS n FROM members m JOIN crowded USING (group_id) GROUP BY 1, 2, 3),
apart AS (SELECT x.group_id, y.group_id AS other FROM decisions d JOIN members x ON x.listing_id IN (d.a, d.b) JOIN members y ON y.listing_id IN (d.a, d.b) AND y.listing_id <> x.listing_id
          WHERE d.reason = 'human_different'),
barred AS (SELECT group_id, list(DISTINCT CAST(other AS VARCHAR)) AS barred FROM apart GROUP BY 1),
shelves AS (SELECT product_key, group_id, list({'s': store, 'w': words, 'n': n} ORDER BY store) AS shelf FROM shelf_rows GROUP BY 1, 2),
tagged AS (SELECT s.product_key, s.group_id, k.place, k.head.c AS core, coalesce(b.barred, []) AS barred, s.shelf,
             CASE WHEN b.barred IS NULL THEN '=' || CAST(list_transform(s.shelf, lambda z: {'s': z.s, 'w': z.w}) AS VARCHAR) ELSE CAST(s.group_id AS VARCHAR) END AS tag
           FROM shelves s JOIN crowded k USING (group_id) LEFT JOIN barred b USING (group_id)),
flat AS (
  SELECT product_key, tag, min(place) AS place, first(barred) AS barred, first(core) AS core FROM tagged GROUP BY 1, 2),
flat_shelves AS (
  SELECT product_key, tag, list({'s': s, 'w': w, 'n': n} ORDER BY s) AS shelf FROM (
    SELECT product_key, tag, z.s AS s, z.w AS w, sum(z.n) AS n FROM (SELECT product_key, tag, unnest(shelf) AS z FROM tagged) GROUP BY ALL) GROUP BY 1, 2),
turns AS (SELECT f.*, shelf, row_number() OVER (PARTITION BY product_key ORDER BY place) AS i FROM flat f JOIN flat_shelves USING (product_key, tag)),
fit AS (
  SELECT product_key, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(p BIGINT, s VARCHAR, w VARCHAR)[]) AS said, CAST([] AS STRUCT(tag VARCHAR, p BIGINT)[]) AS home, CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS BIGINT) AS part
  FROM (SELECT DISTINCT product_key FROM turns)
  UNION ALL
  SELECT product_key, i, list_concat(said, list_transform(shelf, lambda z: {'p': part, 's': z.s, 'w': z.w})), list_append(home, {'tag': tag, 'p': part}), tag, part
  FROM (SELECT t.product_key, t.i, t.tag, t.shelf, f.said, f.home, list_filter(range(0, t.i), lambda p:
          len(list_filter(f.said, lambda x: x.p = p AND len(list_filter(t.shelf, lambda z: z.s = x.s AND z.w <> x.w)) > 0)) = 0
          AND len(list_filter(f.home, lambda h: h.p = p AND list_contains(t.barred, h.tag))) = 0)[1] AS part
        FROM fit f JOIN turns t ON t.product_key = f.product_key AND t.i = f.i + 1)),
parted AS (SELECT t.*, f.part FROM turns t JOIN fit f ON f.product_key = t.product_key AND f.tag = t.tag),
several AS (SELECT * FROM parted WHERE product_key IN (SELECT product_key FROM parted WHERE part > 0)),
spoken0 AS (SELECT product_key, part, z.s AS store, z.w AS words, sum(z.n) AS n FROM (SELECT product_key, part, unnest(shelf) AS z FROM several) GROUP BY ALL),
spoken AS (
  SELECT product_key, part, word, sum(n) AS al, sum(CASE WHEN shared THEN n ELSE 0 END) AS near FROM (
    SELECT s.*, unnest(string_split(words, ' ')) AS word, h.shared FROM spoken0 s JOIN (SELECT product_key, store, count(DISTINCT part) > 1 AS shared FROM spoken0 GROUP BY 1, 2) h USING (product_key, store))
  WHERE word <> '' GROUP BY 1, 2, 3),
part_core AS (SELECT product_key, part, min(array_to_string(core, ' ')) AS core FROM several GROUP BY 1, 2),
part_lists AS (SELECT product_key, part, list({'w': word, 'near': near, 'al': al} ORDER BY word) AS ws, sum(near) AS total FROM spoken GROUP BY 1, 2),
base_part AS (
  SELECT product_key, arg_min(part, (coalesce(total, 0), coalesce(flatten(list_transform(ws, lambda z: list_transform(range(0, CAST(z.near AS BIGINT)), lambda k: z.w))), []), part)) AS base
  FROM part_core LEFT JOIN part_lists USING (product_key, part) GROUP BY 1),
beyond AS (
  SELECT s.*, greatest(s.near - coalesce(b.near, 0), 0) AS more_near, greatest(s.al - coalesce(b.al, 0), 0) AS more_al
  FROM spoken s JOIN base_part p USING (product_key) LEFT JOIN spoken b ON b.product_key = s.product_key AND b.part = p.base AND b.word = s.word),
choices AS (
  SELECT product_key, part, flatten(list(list_transform(range(0, CAST(more_near AS BIGINT)), lambda k: word) ORDER BY word)) AS c1, flatten(list(list_transform(range(0, CAST(near AS BIGINT)), lambda k: word) ORDER BY word)) AS c2,
    flatten(list(list_transform(range(0, CAST(more_al AS BIGINT)), lambda k: word) ORDER BY word)) AS c3, flatten(list(list_transform(range(0, CAST(al AS BIGINT)), lambda k: word) ORDER BY word)) AS c4
  FROM beyond GROUP BY 1, 2),
extras AS (
  SELECT c.product_key, c.part, list_filter(string_split(c.core, ' '), lambda w: w <> '') AS core, CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 WHEN len(c3) > 0 THEN c3 ELSE coalesce(c4, []) END AS extra
  FROM part_core c JOIN base_part b USING (product_key) LEFT JOIN choices h ON h.product_key = c.product_key AND h.part = c.part WHERE c.part <> b.base),
told AS (
  SELECT product_key, part, array_to_string(list_sort(list_concat(extra, list_transform(range(0, row_number() OVER (PARTITION BY product_key, list_sort(list_concat(core, extra)) ORDER BY part)
      - CASE WHEN list_sort(list_concat(core, extra)) = list_sort(core) THEN 0 ELSE 1 END), lambda k: 'apart'))), ' ') AS added FROM extras),
added AS (SELECT t.group_id, coalesce(x.added, '') AS added FROM tagged t JOIN parted p ON p.product_key = t.product_key AND p.tag = t.tag
          LEFT JOIN told x ON x.product_key = p.product_key AND x.part = p.part),
assigned0 AS (SELECT k.*, list_sort(list_concat(head.c, list_filter(string_split(coalesce(a.added, ''), ' '), lambda w: w <> ''))) AS final_core
              FROM group_keys k LEFT JOIN added a USING (group_id) WHERE k.product_key IS NOT NULL),
assigned1 AS (SELECT * EXCLUDE (product_key), concat_ws('|', head.k, array_to_string(final_core, ' '), coalesce(head.g, ''), array_to_string(head.e, ' ')) AS identity FROM assigned0),
assigned AS (SELECT *, concat_ws('#', identity, coalesce(concentration, ''), CAST(volume_ml AS VARCHAR), head.p) AS product_key FROM assigned1),
placed AS (SELECT m.listing_id, m.store, m.name, m.brand, m.group_id, m.confidence, a.product_key, a.identity, a.head.k AS brand_key FROM members m LEFT JOIN assigned a USING (group_id)),
sold AS (SELECT product_key, count(*) AS listings, min(store) <> max(store) AS several_stores FROM placed WHERE product_key IS NOT NULL GROUP BY 1),
status AS (SELECT listing_id, CASE WHEN p.product_key IS NULL THEN 'pending' WHEN several_stores THEN 'matched' ELSE 'new_product' END AS status, p.product_key,
             CASE WHEN p.product_key IS NOT NULL THEN round(confidence, 3) END AS confidence FROM placed p LEFT JOIN sold s ON s.product_key = p.product_key),
products AS (SELECT product_key, any_value(identity) AS identity, any_value(concentration) AS concentration, any_value(volume_ml) AS volume_ml, any_value(head.p) AS presentation,
               any_value(head.k) AS brand_key, any_value(final_core) AS core, any_value(head.g) AS gender, any_value(head.e) AS editions FROM assigned GROUP BY 1)"""

SHOWN_WORDS = """list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\([A-Z]\\)', ' ', 'g'), '\\d+\\s*[mM]l\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '),
  lambda w: trim(lower(w), '.,()') <> '' AND NOT list_contains(""" + str(list(L.audience) + ["para"] + [w for w in L.neutral if w not in L.genders and w != "the"]) + """, trim(lower(w), '.,()'))
  AND len(list_filter([lower(coalesce(brand, '')), lower(display_brand)], lambda b: b <> '' AND (trim(lower(w), '.,()') = b OR (len(trim(lower(w), '.,()')) > 3
    AND levenshtein(trim(lower(w), '.,()'), b) / greatest(len(trim(lower(w), '.,()')), len(b)) <= 0.35)))) = 0)"""

NAMES = PRODUCTS + """,
spellings AS (SELECT brand_key, brand AS spelling, upper(brand) = brand AS shouting, count(*) AS n, min((store, listing_id)) AS first FROM tok WHERE brand IS NOT NULL GROUP BY ALL),
brands AS (
  SELECT k.brand_key, coalesce(x.spelling, upper(substr(u.spelling, 1, 1)) || lower(substr(u.spelling, 2)), '') AS display_brand
  FROM (SELECT DISTINCT brand_key FROM tok) k
  LEFT JOIN (SELECT brand_key, arg_min(spelling, (-n, first)) AS spelling FROM spellings WHERE NOT shouting GROUP BY 1) x ON x.brand_key = k.brand_key
  LEFT JOIN (SELECT brand_key, arg_min(spelling, first) AS spelling FROM spellings GROUP BY 1) u ON u.brand_key = k.brand_key),
worded AS (SELECT p.*, display_brand, """ + SHOWN_WORDS + """ AS parts FROM placed p JOIN brands b ON b.brand_key = p.brand_key WHERE identity IS NOT NULL),
shown AS (SELECT *, CASE WHEN len(list_filter(parts, lambda w: lower(w) <> 'the')) > 0 THEN array_to_string(list_transform(parts, lambda w: regexp_replace(
            CASE WHEN upper(w) = w AND lower(w) <> w THEN upper(substr(w, 1, 1)) || lower(substr(w, 2)) ELSE w END, '^[,()]+|[,()]+$', '', 'g')), ' ') ELSE '' END AS shown FROM worded),
uses AS (SELECT identity, lower(shown) AS spelling, count(*) AS uses FROM shown WHERE shown <> '' GROUP BY 1, 2),
reference AS (
  SELECT identity, display_brand AS brand, count(*) AS listings, arg_min(CASE WHEN shown <> '' THEN shown ELSE display_brand END, k) AS name, arg_min(listing_id, k) AS reference_listing FROM (
    SELECT s.*, (shown = '', regexp_matches(name, '[A-Za-z]\\.[A-Za-z]|[A-Za-z]{2}\\d{2,}'), upper(name) = name AND lower(name) <> name, -coalesce(uses, 0), -len(shown), name, listing_id) AS k
    FROM shown s LEFT JOIN uses u ON u.identity = s.identity AND u.spelling = lower(s.shown)) GROUP BY 1, 2),
traits AS (SELECT identity, any_value(core) AS core, any_value(gender) AS gender, any_value(editions) AS editions, bool_and(presentation = 'travel_set') AS sets_only FROM products GROUP BY 1),
slots AS (SELECT r.*, core, editions, sets_only, coalesce(t.gender, 'unisex') AS gender, lower(brand) AS sb, lower(name) AS sn FROM reference r JOIN traits t USING (identity)),
heads AS (SELECT sb, sn, gender, count(*) AS sharing, arg_min({'i': identity, 'c': core, 'e': editions, 's': sets_only}, (-listings, len(core), identity)) AS h FROM slots GROUP BY 1, 2, 3),
others AS (
  SELECT s.*, (sn, -listings, len(s.core), identity) AS turn, name || ' (' || substr(sha1(identity), 1, 4) || ')' AS coded,
    CASE WHEN len(list_filter(s.core, lambda w: NOT list_contains(h.c, w))) > 0 THEN array_to_string(list_sort(list_distinct(list_filter(s.core, lambda w: NOT list_contains(h.c, w)))), ' ')
      WHEN len(s.editions) > 0 THEN array_to_string(s.editions, ' ') WHEN s.sets_only AND NOT h.s THEN 'estuche'
      WHEN len(list_filter(h.c, lambda w: NOT list_contains(s.core, w))) + len(list_filter(h.e, lambda w: NOT list_contains(s.editions, w))) > 0 THEN 'sin ' || array_to_string(list_concat(
        list_sort(list_distinct(list_filter(h.c, lambda w: NOT list_contains(s.core, w)))), list_sort(list_distinct(list_filter(h.e, lambda w: NOT list_contains(s.editions, w))))), ' ') END AS label
  FROM slots s JOIN heads USING (sb, sn, gender) WHERE sharing > 1 AND s.identity <> h.i),
wanting AS (SELECT *, name || ' (' || label || ')' AS wanted FROM others),
free AS (SELECT * FROM wanting w WHERE wanted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM heads d WHERE d.sb = w.sb AND d.gender = w.gender AND d.sn = lower(w.wanted))),
winners AS (SELECT sb, lower(wanted) AS wn, gender, min(turn) AS turn, arg_min(identity, turn) AS winner FROM free GROUP BY 1, 2, 3),
codes AS (SELECT sb, lower(coded) AS wn, gender, min(turn) AS turn FROM wanting WHERE identity NOT IN (SELECT winner FROM winners) GROUP BY 1, 2, 3),
won AS (SELECT winner FROM winners w LEFT JOIN codes c ON c.sb = w.sb AND c.wn = w.wn AND c.gender = w.gender WHERE c.turn IS NULL OR c.turn > w.turn),
renamed AS (SELECT identity, CASE WHEN identity IN (SELECT winner FROM won) THEN wanted ELSE coded END AS unique_name FROM wanting),
unique_names AS (SELECT s.identity, brand, coalesce(unique_name, name) AS name, gender, listings, unique_name IS NOT NULL AS renamed FROM slots s LEFT JOIN renamed USING (identity))"""


def recursive(text: str, select: str) -> str:
    return f"WITH RECURSIVE {text} {select}"


DECIDED, RULED = decided(True), decided(False)
