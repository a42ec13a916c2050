"""Text, payload, vector and table queries over documents, pages, part and embeddings."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shelfwise.functions import fixed
from shelfwise.functions import text as X
from shelfwise.functions import urls as U
from shelfwise.operators import catalog as C
from shelfwise.operators import embed as E
from shelfwise.operators import ingest as I
from shelfwise.operators import mentions as H
from shelfwise.operators import tokens
from shelfwise.sources import labels as L
from shelfwise.sources import payloads as Y
from shelfwise.session import work_folder
from shelfwise.sources import tables as T

from . import match_queries as Q
from . import match_sql as S
from . import views as V
from .registry import query

END = r"([^\p{L}\p{N}_]|$)"
START = r"(^|[^\p{L}\p{N}_])"


# ---------------------------------------------------------------- documents

CONCENTRATION_SQL = f"""CASE
  WHEN regexp_matches(x, '{START}(eau|agua)\\s+(de|the)\\s+(parfum|perfume|perfum){END}', 'i') THEN 'EDP'
  WHEN regexp_matches(x, '{START}eau\\s+de\\s+toil+et+e{END}', 'i') THEN 'EDT'
  WHEN regexp_matches(x, '{START}(eau\\s+de\\s+cologne|agua\\s+de\\s+colonia){END}', 'i') THEN 'EDC'
  WHEN regexp_matches(x, '{START}edp{END}', 'i') THEN 'EDP' WHEN regexp_matches(x, '{START}edt{END}', 'i') THEN 'EDT'
  WHEN regexp_matches(x, '{START}edc{END}', 'i') THEN 'EDC' WHEN regexp_matches(x, '{START}parfum{END}', 'i') THEN 'PARFUM'
  WHEN regexp_matches(x, '{START}col[oó]nia{END}', 'i') THEN 'EDC' END"""
VOLUME_SQL = f"nullif(regexp_extract(x, '(^|[^\\d.,])(\\d+(?:[.,]\\d+)?\\s*(?:ml|lts?|litros?|l|cc|un)){END}', 2, 'i'), '')"


@query("extract_volume", f"SELECT doc_id, {VOLUME_SQL} AS volume FROM (SELECT doc_id, text AS x FROM documents)")
def extract_volume(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", X.extract_volume(F.col("text")).alias("volume"))


@query("concentration", f"SELECT doc_id, {CONCENTRATION_SQL} AS concentration FROM (SELECT doc_id, text AS x FROM documents)")
def concentration(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", X.extract_concentration(F.col("text")).alias("concentration"))


@query("fold_search", f"SELECT doc_id, md5(translate(lower(text), '{fixed.PLAIN_FROM.replace(chr(39), chr(39) * 2)}', '{fixed.PLAIN_TO}')) AS folded FROM documents")
def fold_search(spark, folder):
    return V.table(spark, folder, "documents").select("doc_id", F.md5(X.plain(F.col("text"))).alias("folded"))


@query("repair_encoding", r"""
SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN trim(regexp_replace(text, '[\s\x{A0}]+', ' ', 'g')) ELSE text END) AS repaired FROM documents""")
def repair_encoding(spark, folder):
    """Every document's UTF-8 bytes read as Latin-1, then repaired."""
    broken = V.table(spark, folder, "documents").select("doc_id", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1").alias("text"))
    return X.repair_encoding(broken, "text").select("doc_id", F.md5("text").alias("repaired"))


# ---------------------------------------------------------------- sizes, prices, cards written from part

WRITTEN_SQL = """
w AS (SELECT p_partkey AS k, p_name || ' ' || CASE p_partkey % 9 WHEN 0 THEN 'EDP 1,5 L' WHEN 1 THEN 'edt 1.000 ml' WHEN 2 THEN 'Eau de Parfum ' || p_size || 'ml'
    WHEN 3 THEN 'x3 un' WHEN 4 THEN 'Colonia ' || p_size || ' cc' WHEN 5 THEN 'parfum ' || p_size || '.5 ml' WHEN 6 THEN 'EDT' || p_size || ' Ml' WHEN 7 THEN 'Set ' || p_size || ' Lts' ELSE '' END AS name,
  CASE WHEN p_partkey % 21 = 0 THEN 'free' WHEN p_partkey % 20 = 0 THEN '' ELSE '$' || replace(format('{:,}', CAST(round(p_retailprice * 10) AS BIGINT)), ',', '.') END AS price_text,
  p_brand, p_type, p_size, p_retailprice FROM part)"""


def written(spark, folder):
    p = V.table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 9
    tail = (F.when(k == 0, "EDP 1,5 L").when(k == 1, "edt 1.000 ml").when(k == 2, F.concat(F.lit("Eau de Parfum "), size, F.lit("ml"))).when(k == 3, "x3 un")
            .when(k == 4, F.concat(F.lit("Colonia "), size, F.lit(" cc"))).when(k == 5, F.concat(F.lit("parfum "), size, F.lit(".5 ml")))
            .when(k == 6, F.concat(F.lit("EDT"), size, F.lit(" Ml"))).when(k == 7, F.concat(F.lit("Set "), size, F.lit(" Lts"))).otherwise(""))
    amount = F.round(F.col("p_retailprice") * 10).cast("bigint")
    price = F.when(F.col("p_partkey") % 21 == 0, "free").when(F.col("p_partkey") % 20 == 0, "").otherwise(
        F.concat(F.lit("$"), F.translate(F.format_number(amount, 0), ",", ".")))
    return p.select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), tail).alias("name"), price.alias("price_text"), "p_brand", "p_type", "p_size", "p_retailprice")


ML_SQL = """CASE WHEN k % 9 = 0 THEN 1500 WHEN k % 9 = 1 THEN 1000 WHEN k % 9 IN (2, 4, 6) THEN p_size WHEN k % 9 = 5 THEN p_size + 1 WHEN k % 9 = 7 THEN p_size * 1000 END"""


@query("to_volume", f"WITH {WRITTEN_SQL} SELECT k, {ML_SQL} AS volume_ml, {VOLUME_SQL} AS volume FROM (SELECT *, name AS x FROM w)")
def to_volume(spark, folder):
    found = X.extract_volume(F.col("name"))
    return written(spark, folder).select("k", found.alias("volume"), X.to_volume_ml(found).alias("volume_ml"))


@query("to_price", f"WITH {WRITTEN_SQL}" + """
SELECT k, CASE WHEN price_text LIKE '$%' THEN CAST(replace(substr(price_text, 2), '.', '') AS BIGINT) END AS price, price_text = 'free' AS bad,
  CASE WHEN round_even(p_retailprice, 0) > 0 THEN '$' || replace(format('{:,}', CAST(round_even(p_retailprice, 0) AS BIGINT)), ',', '.') END AS shown FROM w""")
def to_price(spark, folder):
    return written(spark, folder).select("k", X.to_price(F.col("price_text")).alias("price"), X.bad_price(F.col("price_text")).alias("bad"),
                                         X.price_text(F.col("p_retailprice").cast("string")).alias("shown"))


def card_rows(spark, folder):
    w = written(spark, folder)
    return w.select(
        F.when(F.col("k") % 2 == 0, "salcobrand").otherwise("maicao").alias("store"), F.concat(F.lit("f"), (F.col("k") % 10).cast("string")).alias("file"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("scraped_at"), F.col("k").alias("position"), F.when(F.col("k") % 25 != 0, F.col("name")).alias("name"),
        F.col("p_brand").alias("brand"), F.col("price_text").alias("current_price"), F.lit(None).cast("string").alias("previous_price"),
        F.lit(None).cast("string").alias("volume"), F.when(F.col("k") % 22 == 0, "EDX").alias("concentration"),
        F.concat(F.lit("https://s.example/p/"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("x?cgid=9&default_sku="), F.col("k").cast("string"), F.lit("#top"))).otherwise(
            F.concat(F.lit("CLMC_"), F.col("k").cast("string"), F.lit(".html?cgid=1")))).alias("url"),
        F.concat(F.when(F.col("k") % 3 == 0, "http").otherwise("https"), F.lit("://img.example/"), F.col("k").cast("string")).alias("image_url"),
        F.when(F.col("k") % 4 == 0, fixed.OUT_OF_STOCK).otherwise("available").alias("availability"),
        F.when(F.col("k") % 18 == 0, "sizes disagree").alias("volume_note"),
        F.when(F.col("k") % 5 == 0, F.array(F.lit("Masculino"))).when(F.col("k") % 5 == 1, F.array(F.lit("Femenino"), F.lit("Masculino"))).when(
            F.col("k") % 5 == 2, F.array(F.lit("Unisex"))).when(F.col("k") % 5 == 3, F.array(F.lit("Otro"))).alias("declared_gender"))


@query("parse_products", f"WITH {WRITTEN_SQL}" + f"""
SELECT k AS position, CASE WHEN k % 25 = 0 THEN 'missing url/name' WHEN k % 22 = 0 THEN 'unknown concentration' WHEN price_text = 'free' THEN 'unrecognized price' END AS problem,
  CASE WHEN k % 2 = 0 THEN 'https://s.example/p/x?default_sku=' || k ELSE 'https://s.example/p/CLMC_' || k || '.html' END AS listing_url,
  CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE 'CLMC_' || k END AS store_sku,
  CASE WHEN k % 22 <> 0 AND k % 25 <> 0 THEN CASE k % 9 WHEN 0 THEN 'edp' WHEN 1 THEN 'edt' WHEN 2 THEN 'edp' WHEN 4 THEN 'cologne' WHEN 5 THEN 'parfum' END END AS parsed_concentration,
  CASE WHEN k % 25 <> 0 AND k % 18 <> 0 THEN {ML_SQL} END AS parsed_volume_ml, k % 4 <> 0 AS is_available,
  CASE WHEN k % 3 <> 0 THEN 'https://img.example/' || k END AS image_url,
  CASE k % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'unisex' WHEN 2 THEN 'unisex' END AS declared_gender FROM w""")
def parse_products(spark, folder):
    return I.parsed_cards(card_rows(spark, folder)).select(
        "position", "problem", "listing_url", "store_sku", "parsed_concentration", "parsed_volume_ml", "is_available", "image_url", "declared_gender")


@query("normalize_urls", r"""
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS listing_url, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages""")
def normalize_urls(spark, folder):
    p = V.table(spark, folder, "pages")
    return p.select("page_id", U.normalize_url(F.col("url")).alias("listing_url"), U.query_parameter(F.col("url"), "page").alias("page"))


# ---------------------------------------------------------------- payloads

def clp_sql(x):
    return f"'$' || replace(format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT)), ',', '.')"


@query("shop_json", f"WITH {WRITTEN_SQL}" + f"""
SELECT k, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name, p_brand AS brand, {clp_sql('p_retailprice')} AS current_price,
  CASE WHEN k % 3 = 0 THEN {clp_sql('p_retailprice + 500')} END AS previous_price, {VOLUME_SQL} AS volume, {CONCENTRATION_SQL} AS concentration,
  'https://shop.example/products/h-' || k AS url, CASE WHEN k % 4 = 0 THEN 'Sin stock online' ELSE 'available' END AS availability
FROM (SELECT *, name AS x FROM w)""")
def shop_json(spark, folder):
    w = written(spark, folder)
    k = F.col("k").cast("string")
    variant = F.struct(F.col("p_retailprice").cast("string").alias("price"), F.when(F.col("k") % 3 == 0, (F.col("p_retailprice") + 500).cast("string")).otherwise("").alias("compare_at_price"),
                       k.alias("sku"), (F.col("k") % 4 != 0).alias("available"))
    payload = F.to_json(F.struct(k.alias("id"), F.concat(F.lit(" "), "name", F.lit("  ")).alias("title"), F.concat(F.lit("h-"), k).alias("handle"),
                                 F.concat(F.lit(" "), "p_brand").alias("vendor"), F.array(variant).alias("variants"), F.col("p_type").alias("product_type")))
    return Y.from_shop_json(w.select("k", payload.alias("payload")), base_url="https://shop.example").select(
        "k", "name", "brand", "current_price", "previous_price", "volume", "concentration", "url", "availability")


@query("store_api", f"WITH {WRITTEN_SQL}" + f"""
SELECT k, trim(regexp_replace(name, '\\s+', ' ', 'g')) || ' & co' AS name, p_brand AS brand,
  CASE WHEN k % 9 = 8 THEN '77 ml' WHEN {ML_SQL} = 77 THEN {VOLUME_SQL} END AS volume, k % 9 = 3 OR (k % 9 <> 8 AND {ML_SQL} <> 77) AS disagrees,
  CASE k % 5 WHEN 0 THEN 'Masculino' ELSE 'Femenino,Masculino' END AS genders
FROM (SELECT *, name AS x FROM w)""")
def store_api(spark, folder):
    w = written(spark, folder)
    k = F.col("k").cast("string")
    term = lambda *names: F.array(*[F.struct(F.lit(n).alias("name")) if isinstance(n, str) else F.struct(n.alias("name")) for n in names])
    attribute = lambda taxonomy, terms: F.struct(F.lit(taxonomy).alias("taxonomy"), terms.alias("terms"))
    attributes = F.array(attribute("pa_marcas", term(F.col("p_brand"))), attribute("pa_formato", term("77 ml")),
                         attribute("pa_genero", F.when(F.col("k") % 5 == 0, term("Masculino")).otherwise(term("Femenino", "Masculino"))))
    payload = F.to_json(F.struct(k.alias("id"), F.concat("name", F.lit(" &amp; co")).alias("name"), attributes.alias("attributes")))
    rows = Y.from_store_api(w.select("k", payload.alias("payload")))
    return rows.select("k", "name", "brand", "volume", F.col("volume_note").isNotNull().alias("disagrees"), F.array_join("declared_gender", ",").alias("genders"))


@query("search_hits", f"WITH {WRITTEN_SQL}" + f"""
SELECT k, {clp_sql('p_retailprice - CASE WHEN k % 2 = 0 THEN 100 ELSE 0 END')} AS current_price, CASE WHEN k % 2 = 0 THEN {clp_sql('p_retailprice')} END AS previous_price,
  CASE WHEN k % 6 = 0 THEN '33ml' ELSE coalesce({VOLUME_SQL}, '44 ml') END AS volume, coalesce({CONCENTRATION_SQL}, 'EDT') AS concentration,
  'https://s.example/products/a-edt-44-ml?default_sku=' || k AS url FROM (SELECT *, name AS x FROM w)""")
def search_hits(spark, folder):
    w = written(spark, folder)
    payload = F.to_json(F.struct(
        F.col("k").cast("string").alias("sku"), "name", F.when(F.col("k") % 2 == 0, F.col("p_retailprice") - 100).otherwise(F.col("p_retailprice")).cast("string").alias("direct_discount"),
        F.col("p_retailprice").cast("string").alias("normal_price"), F.when(F.col("k") % 6 == 0, "33ml").otherwise("").alias("options_text"), F.lit("a-edt-44-ml").alias("slug")))
    return Y.from_search_hit(w.select("k", payload.alias("payload")), base_url="https://s.example").select("k", "current_price", "previous_price", "volume", "concentration", "url")


@query("listing_results", """
SELECT p_partkey AS capture_id, 'r' || p_partkey AS result, CASE WHEN p_partkey % 3 = 0 THEN 'cyber:Si' ELSE '' END || CASE WHEN p_partkey % 15 = 0 THEN '|' ELSE '' END
  || CASE WHEN p_partkey % 5 = 0 THEN 'filters=a < 1' ELSE '' END AS extra FROM part WHERE p_partkey % 7 <> 0""")
def listing_results(spark, folder):
    p = V.table(spark, folder, "part")
    k = F.col("p_partkey")
    facets = F.concat(F.lit('[["product_categories.lvl1:Perfumes"]'), F.when(k % 3 == 0, ',"cyber:Si"').otherwise(""), F.lit("]"))
    params = F.concat(F.lit("hitsPerPage="), F.when(k % 7 == 0, "0").otherwise("24"), F.lit("&facetFilters="), F.url_encode(facets), F.lit("&filters="),
                      F.url_encode(F.when(k % 5 == 0, "a < 1").otherwise("(timestamp_available_on < 17)")))
    rows = p.select(k.alias("capture_id"), F.array(params, F.lit("hitsPerPage=0")).alias("requests"), F.array(F.concat(F.lit("r"), k.cast("string")), F.lit("x")).alias("results"))
    return Y.listing_results(rows, "Perfumes").select("capture_id", "result", F.array_join("extra", "|").alias("extra"))


ENTITIES_SQL = "replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"


@query("html_cards", f"""
WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS card, generate_subscripts(regexp_extract_all(html, '<li>(.*?)</li>', 1), 1) - 1 AS position FROM pages)
SELECT page_id, position, nullif(trim(regexp_replace({ENTITIES_SQL.format("regexp_extract(card, 'href=\"([^\"]+)\"', 1)")}, '\\s+', ' ', 'g')), '') AS path,
  nullif(trim(regexp_replace({ENTITIES_SQL.format("regexp_extract(card, '<a[^>]*>([^<]*)<', 1)")}, '\\s+', ' ', 'g')), '') AS name FROM c""")
def html_cards(spark, folder):
    rows = Y.cards(V.table(spark, folder, "pages").select("page_id", "html"), card="(?s)<li>(.*?)</li>")
    return Y.card_fields(rows, {"path": r'href="([^"]+)"', "name": r"<a[^>]*>([^<]*)<"}, ("path", "name")).select(
        "page_id", F.col("position").cast("bigint").alias("position"), "path", "name")


@query("html_totals", r"""
SELECT page_id, TRY_CAST(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS INT) AS site_total,
  coalesce(list_max(list_transform(regexp_extract_all(html, '<!-- ad (\d+) -->', 1), lambda x: TRY_CAST(x AS INT))), 1) AS last_page FROM pages""")
def html_totals(spark, folder):
    return Y.page_totals(V.table(spark, folder, "pages").select("page_id", "html"), total=r"track\((\d+)\)", link=r"<!-- ad (\d+) -->")


@query("json_ld", """
SELECT p_partkey AS k, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS current_price, CASE WHEN p_partkey % 2 = 0 THEN 'https://i.example/a' ELSE 'https://i.example/b' END AS image_url FROM part""")
def json_ld(spark, folder):
    p = V.table(spark, folder, "part")
    brand = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('{"name": "'), "p_brand", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    image = F.when(F.col("p_partkey") % 2 == 0, '["https://i.example/a", "x"]').otherwise('"https://i.example/b"')
    body = F.concat(F.lit('{"@type": "Product", "name": "'), "p_name", F.lit('", "brand": '), brand, F.lit(', "image": '), image, F.lit(', "offers": {"price": "'), F.col("p_size").cast("string"), F.lit('"}}'))
    block = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('[{"@type": "Thing", "name": "no"}, '), body, F.lit("]"))).otherwise(body)
    html = F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script></html>"))
    return Y.json_ld_products(p.select(F.col("p_partkey").alias("k"), html.alias("html"))).select("k", "name", "brand", "current_price", "image_url")


@query("pick_two_prices", """
SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 3 THEN '$2' || p_size WHEN p_partkey % 4 = 2 THEN NULL ELSE '$1' || p_size END AS current_price,
  CASE WHEN p_partkey % 4 = 1 THEN '$2' || p_size END AS list_price FROM part""")
def pick_two_prices(spark, folder):
    p = V.table(spark, folder, "part")
    node = lambda text, struck: F.struct(text.alias("text"), F.lit(struck).alias("struck"))
    size, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    plain, struck = node(F.concat(F.lit("$1"), size), False), node(F.concat(F.lit("$2"), size), True)
    unit = node(F.concat(F.lit("$9 x "), size), False)
    nodes = F.when(k == 0, F.array(unit, plain)).when(k == 1, F.array(struck, unit, plain)).when(k == 2, F.array(unit)).otherwise(F.array(struck, unit))
    current, full = Y.pick_prices(F.col("nodes"))
    return p.select(F.col("p_partkey").alias("k"), nodes.alias("nodes")).select("k", current.alias("current_price"), full.alias("list_price"))


@query("site_total", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 <> 0 THEN 1000 + p_size END AS total FROM part")
def site_total(spark, folder):
    p = V.table(spark, folder, "part")
    texts = F.array(F.lit("perfumes"), F.col("p_name"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit(" 1.0"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit(" producto s "))).otherwise("none"))
    return p.select(F.col("p_partkey").alias("k"), Y.site_total(texts).alias("total"))


@query("search_responses", """
SELECT count(*) FILTER (WHERE p_partkey % 3 = 0) AS unpriced, count(*) FILTER (WHERE p_partkey % 4 = 1) AS pictured, max(p_partkey) AS site_total,
  count(*) AS totals_seen FROM part""")
def search_responses(spark, folder):
    p = V.table(spark, folder, "part")
    k = F.col("p_partkey")
    image = F.struct(F.when(k % 4 == 0, "https://i.example/ND.jpg").when(k % 4 == 1, "https://i.example/x.jpg?w=1").when(k % 4 == 2, "http://i.example/y.jpg").alias("disBaseLink"))
    payload = F.to_json(F.struct(k.cast("int").alias("total"), F.array(F.struct(k.cast("string").alias("productId"), F.when(k % 3 != 0, F.lit(9.5)).alias("price"), image.alias("image"))).alias("hits")))
    rows = p.select(F.lit("https://s.example/product-search?refine=cgid%3D7&offset=0").alias("url"), k.alias("read_at"), payload.alias("payload"))
    pages = Y.search_pages(rows)
    hits = Y.search_hits(pages)
    totals = Y.search_totals(pages, "7").select(F.col("site_total").cast("bigint").alias("site_total"), "totals_seen")
    return totals.select(Y.unpriced_hits(hits).agg(F.count(F.lit(1))).scalar().alias("unpriced"), Y.hit_images(hits).agg(F.count(F.lit(1))).scalar().alias("pictured"), "site_total", "totals_seen")


@query("detail_enrich", f"WITH {WRITTEN_SQL}" + f"""
SELECT k, coalesce({VOLUME_SQL}, CASE WHEN k % 2 = 0 THEN '88 ml' END) AS volume, CASE WHEN {VOLUME_SQL} IS NOT NULL THEN 'listing' WHEN k % 2 = 0 THEN 'detail' END AS volume_source,
  coalesce({CONCENTRATION_SQL}, CASE WHEN k % 4 = 0 THEN 'EDT' WHEN k % 4 = 2 THEN 'EDP' END) AS concentration,
  CASE WHEN {CONCENTRATION_SQL} IS NOT NULL THEN 'listing' WHEN k % 4 = 0 THEN 'title' WHEN k % 4 = 2 THEN 'sheet' END AS concentration_source
FROM (SELECT *, name AS x FROM w)""")
def detail_enrich(spark, folder):
    w = written(spark, folder)
    products = w.select("k", F.col("k").alias("url"), X.extract_volume(F.col("name")).alias("volume"), X.extract_concentration(F.col("name")).alias("concentration"))
    even = w.where(F.col("k") % 2 == 0)
    title = even.select(F.col("k").alias("url"), F.lit("title").alias("source"), F.when(F.col("k") % 4 == 0, "Aqua Eau de Toilette").otherwise("Aqua").alias("text"))
    sheet = even.select(F.col("k").alias("url"), F.lit("sheet").alias("source"), F.lit("EDP\nContenido: 88 ml\nmore").alias("text"))
    return Y.enrich(products, title.unionByName(sheet), ("title", "sheet")).drop("url")


@query("exclusion_counts", """
WITH n AS (SELECT CASE p_partkey % 8 WHEN 0 THEN 'tester' WHEN 1 THEN 'set_with_lotion' WHEN 2 THEN 'body_lotion' WHEN 3 THEN 'deodorant' WHEN 4 THEN 'kept' WHEN 5 THEN 'tester' ELSE 'kept' END AS reason, p_partkey // 2 AS id, p_partkey FROM part)
SELECT reason, count(*) AS products FROM (SELECT id, arg_min(reason, p_partkey) AS reason FROM n GROUP BY 1) GROUP BY 1""")
def exclusion_counts(spark, folder):
    p = V.table(spark, folder, "part")
    k = F.col("p_partkey") % 8
    tail = F.when(k == 0, " TESTER").when(k == 1, " set + loción").when(k == 2, " body Lotion").when(k == 3, " Desodorante").when(k == 4, " kit desodorante").otherwise("")
    rows = p.select(F.concat("p_name", tail).alias("name"), F.when(k == 5, "red tester 5").otherwise("").alias("slug"), F.floor(F.col("p_partkey") / 2).alias("source_id"), F.col("p_partkey").alias("position"))
    return Y.walk_counts(rows.withColumn("reason", Y.exclusion("html_card")))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events")
def json_props(spark, folder):
    e = V.table(spark, folder, "events")
    return e.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"), "event_type")


@query("local_days", "SELECT event_id, CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, date_diff('day', CAST(ts - INTERVAL 3 HOUR AS DATE), DATE '2024-02-01') AS days_ago FROM events")
def local_days(spark, folder):
    """Calendar days in a zone three hours behind."""
    from shelfwise.operators.prices import local_day

    day = local_day(F.col("ts").cast("timestamp"), "America/Santiago")
    shown = V.table(spark, folder, "events").select("event_id", day.alias("d"))
    return shown.select("event_id", F.col("d").cast("string").alias("day"), F.date_diff(F.lit("2024-02-01").cast("date"), "d").cast("bigint").alias("days_ago"))


# ---------------------------------------------------------------- vectors

@query("semantic_top", f"WITH {V.PRODUCTS_SQL}" + """,
q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) AS c FROM embeddings CROSS JOIN q ORDER BY c DESC, vec_id LIMIT 200)
SELECT p.product_id, p.canonical_name, round_even(c, 4) AS similarity FROM products p JOIN near ON near.vec_id = p.product_id % (SELECT count(*) FROM embeddings)
ORDER BY similarity DESC, canonical_name, product_id LIMIT 25""")
def semantic_top(spark, folder):
    vectors = V.table(spark, folder, "embeddings")
    wanted = vectors.orderBy("vec_id").select("embedding").first()["embedding"]
    count = vectors.agg(F.count(F.lit(1))).scalar()
    summary = V.products(spark, folder).withColumn("fragrance_id", F.pmod("product_id", count))
    fragrances = vectors.select(F.col("vec_id").alias("fragrance_id"), "embedding")
    return C.semantic_search(wanted, fragrances, summary, limit=25).select("product_id", "canonical_name", "similarity")


@query("embed_text", """
WITH c AS (SELECT doc_id, list_transform(string_split(' ' || text || ' ', ''), lambda x: CAST(unicode(x) AS BIGINT)) AS c FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda i: (c[i] * 131 + c[i + 1]) * 131 + c[i + 2])) AS h FROM c),
s AS (SELECT doc_id, h % 64 AS pos, CAST(sum(CASE WHEN h // 64 % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS s FROM g GROUP BY 1, 2)
SELECT doc_id, pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY doc_id)), 2) AS value FROM s WHERE s <> 0""")
def embed_text(spark, folder):
    """The vectors by value: every component that isn't zero."""
    made = E.embed(V.table(spark, folder, "documents").where("text IS NOT NULL"), key="doc_id")
    return made.select("doc_id", F.posexplode("embedding").alias("pos", "v")).where("v <> 0").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 2).alias("value"))


@query("embed_queries", "SELECT conv_id, turn, 64 AS dimensions, 1.0 AS norm FROM conversations")
def embed_queries(spark, folder):
    from shelfwise.functions.vectors import norm
    from shelfwise.operators.tokens import listing_text

    rows = V.table(spark, folder, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), listing_text(F.lit(None).cast("string"), X.expand_abbreviations(F.col("text"))).alias("text"))
    made = E.embed(rows, key="id")
    part = F.split("id", "-")
    return made.select(part[0].cast("bigint").alias("conv_id"), part[1].cast("bigint").alias("turn"), F.size("embedding").alias("dimensions"), F.round(norm(F.col("embedding")), 3).alias("norm"))


@query("vector_refresh", "SELECT vec_id AS listing_id, vec_id % 5 = 0 OR vec_id % 7 = 0 AS read FROM embeddings")
def vector_refresh(spark, folder):
    """Every fifth cached vector is stale, every seventh missing."""
    source = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("listing_id"), "embedding")
    digests = source.select("listing_id", T.vector_digest(F.col("embedding")).alias("digest"))
    cached = source.where("listing_id % 7 <> 0").select(
        "listing_id", F.when(F.col("listing_id") % 5 == 0, "old").otherwise(T.vector_digest(F.col("embedding"))).alias("digest"), "embedding")
    return T.refresh_vectors(cached, digests, source).select("listing_id", "read")


@query("fill_vectors", "SELECT vec_id AS listing_id, len(embedding) AS dimensions FROM embeddings")
def fill_vectors(spark, folder):
    source = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("listing_id"), "embedding")
    holes = source.withColumn("embedding", F.when(F.col("listing_id") % 3 != 0, F.col("embedding")))
    return T.fill_vectors(holes, source).select("listing_id", F.size("embedding").cast("bigint").alias("dimensions"))


# ---------------------------------------------------------------- mentions

NAMES_SQL = r"""
names AS (SELECT item_id AS product_id, lower(trim(regexp_replace(replace(text, '*', ''), '\s+', ' ', 'g'))) AS key FROM benchmark),
bodies AS (SELECT doc_id AS text_id, lower(trim(regexp_replace(replace(text, '*', ''), '\s+', ' ', 'g'))) AS body FROM documents)"""


def names_and_texts(spark, folder):
    names = V.table(spark, folder, "benchmark").select(F.col("item_id").alias("product_id"), F.col("text").alias("name"))
    return V.table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "text"), names


@query("found_names", f"WITH {NAMES_SQL} SELECT text_id, product_id, instr(body, key) AS start FROM bodies JOIN names ON key <> '' AND contains(body, key)")
def found_names(spark, folder):
    return H.found_names(*names_and_texts(spark, folder)).select("text_id", "product_id", "start")


@query("mentions", f"WITH RECURSIVE {NAMES_SQL}" + """,
hits AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY start, size DESC, product_id) AS i FROM (
  SELECT text_id, product_id, instr(body, key) AS start, length(key) AS size FROM bodies JOIN names ON key <> '' AND contains(body, key))),
walk AS (
  SELECT text_id, i, product_id, start, start + size AS free, true AS kept FROM hits WHERE i = 1
  UNION ALL
  SELECT h.text_id, h.i, h.product_id, h.start, CASE WHEN h.start >= w.free THEN h.start + h.size ELSE w.free END, h.start >= w.free
  FROM walk w JOIN hits h ON h.text_id = w.text_id AND h.i = w.i + 1)
SELECT text_id, product_id, start FROM walk WHERE kept""")
def mentions(spark, folder):
    return H.mentions(*names_and_texts(spark, folder))


# ---------------------------------------------------------------- labels and tables

LABEL_ROWS_SQL = """
rows AS (SELECT 'file' || quality AS file, doc_id AS row, 'https://a.example/' || CAST(doc_id % 90 AS VARCHAR) AS ua, 'https://b.example/' || CAST(doc_id % 70 AS VARCHAR) AS ub,
           CASE WHEN toxic = 1 THEN 'different' WHEN doc_id % 11 = 0 THEN '' ELSE 'same' END AS label FROM labels),
keyed AS (SELECT file, row, least(ua, ub) AS url_a, greatest(ua, ub) AS url_b, label FROM rows WHERE label <> '')"""


def label_rows(spark, folder):
    l = V.table(spark, folder, "labels")
    return l.select(F.concat(F.lit("file"), F.col("quality").cast("string")).alias("file"), F.col("doc_id").alias("row"),
                    F.concat(F.lit(" https://b.example/"), (F.col("doc_id") % 70).cast("string")).alias("url_a"), F.concat(F.lit("https://a.example/"), (F.col("doc_id") % 90).cast("string")).alias("url_b"),
                    F.when(F.col("toxic") == 1, "different").when(F.col("doc_id") % 11 == 0, "").otherwise("same").alias("label"))


@query("labels_last_wins", f"WITH {LABEL_ROWS_SQL} SELECT url_a, url_b, arg_max(label, (file, row)) AS label, max(file) AS source FROM keyed GROUP BY 1, 2")
def labels_last_wins(spark, folder):
    return L.last_wins(label_rows(spark, folder))


@query("labels_first_wins", f"WITH {LABEL_ROWS_SQL} SELECT url_a, url_b, arg_min(label, (file, row)) AS label, min(file) AS source, count(DISTINCT label) > 1 AS conflict FROM keyed GROUP BY 1, 2")
def labels_first_wins(spark, folder):
    return L.first_wins(label_rows(spark, folder))


REVIEW_RANK = "CASE {s}.store WHEN 'store3' THEN 0 WHEN 'store1' THEN 1 ELSE 2 END"


@query("review_queue", S.recursive(S.DECIDED + S.REVIEWS, f""", oriented AS (
  SELECT *, {REVIEW_RANK.format(s='y')} < {REVIEW_RANK.format(s='x')} AS swap FROM reviews JOIN tok x ON x.listing_id = a JOIN tok y ON y.listing_id = b)
SELECT printf('%.3f', r.similarity) AS similarity, r.reason, '' AS label, '' AS reviewer_note, l.store AS store_a, l.name AS name_a, l.volume_ml AS volume_ml_a, l.concentration AS concentration_a,
  l.listing_url AS url_a, t.store AS store_b, t.name AS name_b, t.volume_ml AS volume_ml_b, t.concentration AS concentration_b, t.listing_url AS url_b
FROM (SELECT similarity, reason, CASE WHEN swap THEN b ELSE a END AS l, CASE WHEN swap THEN a ELSE b END AS t FROM oriented) r JOIN tok l ON l.listing_id = r.l JOIN tok t ON t.listing_id = r.t"""))
def review_queue(spark, folder):
    from shelfwise.operators import grouping as G

    rows, d, accepted = Q.grouped(spark, folder)
    return L.review_rows(G.review_queue(d, accepted, rows), rows, ("store3", "store1"))


@query("review_file", S.recursive(S.DECIDED + S.REVIEWS, f""", oriented AS (
  SELECT *, {REVIEW_RANK.format(s='y')} < {REVIEW_RANK.format(s='x')} AS swap, x.listing_url AS ux, y.listing_url AS uy FROM reviews JOIN tok x ON x.listing_id = a JOIN tok y ON y.listing_id = b)
SELECT printf('%.3f', similarity) AS similarity, reason, CASE WHEN swap THEN uy ELSE ux END AS url_a, CASE WHEN swap THEN ux ELSE uy END AS url_b FROM oriented"""))
def review_file(spark, folder):
    """The queue as reviewers get it: written as CSV and read back."""
    path = work_folder(spark, "review")
    L.write_review(review_queue(spark, folder), path)
    return spark.read.csv(path, header=True).select("similarity", "reason", "url_a", "url_b")


@query("table_upsert_sink", """
WITH base AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN shipped >= TIMESTAMP '1999-01-01' AND l_linenumber % 2 = 0 THEN price + 1 ELSE price END AS price,
  CASE WHEN shipped < TIMESTAMP '1999-01-01' THEN 'unchanged' WHEN shipped >= TIMESTAMP '2000-01-01' THEN 'inserted' WHEN l_linenumber % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS change FROM base""")
def table_upsert_sink(spark, folder):
    base = V.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_shipdate").alias("at"))
    stored = base.where("at < timestamp_ntz '2000-01-01'").drop("at")
    changes = base.where("at >= timestamp_ntz '1999-01-01'").withColumn("price", F.when(F.col("l_linenumber") % 2 == 0, F.col("price") + 1).otherwise(F.col("price"))).drop("at")
    return T.merge(stored, changes, ["l_orderkey", "l_linenumber"])


@query("export_check", "SELECT 'embeddings' AS name, 'vec_id,label' AS columns, count(*) AS rows FROM embeddings")
def export_check(spark, folder):
    return T.manifest(V.table(spark, folder, "embeddings").drop("embedding"), "embeddings")


@query("listing_scan", "SELECT l_partkey * 6 + l_suppkey % 6 AS listing_id FROM lineitem WHERE l_suppkey % 6 IN (1, 2, 4) AND (l_partkey * 6 + l_suppkey % 6) % 7 <> 0 GROUP BY 1")
def listing_scan(spark, folder):
    """Active listings of the chosen stores: both filters sit on the listing table before anything is joined."""
    return V.listings(spark, folder).where(F.col("is_active") & F.col("store").isin("store1", "store2", "store4")).select("listing_id")


@query("listing_names", """
SELECT p_partkey AS listing_id, p_name || ' né' || CASE p_size % 4 WHEN 0 THEN ' (M)' WHEN 1 THEN ' (H)' ELSE '' END AS raw_name
FROM part JOIN embeddings ON vec_id = p_partkey WHERE embedding IS NOT NULL AND p_partkey % 7 <> 0 AND p_partkey % 6 IN (1, 2, 4)""")
def listing_names(spark, folder):
    """Listings as matching reads them: names were read in the wrong encoding, some shops declare a gender."""
    gender = F.when(F.col("p_size") % 4 == 0, "female").when(F.col("p_size") % 4 == 1, "male").when(F.col("p_size") % 4 == 2, "unisex")
    listings = V.table(spark, folder, "part").select(
        F.col("p_partkey").alias("listing_id"), F.concat(F.lit("store"), (F.col("p_partkey") % 6).cast("string")).alias("store"),
        (F.col("p_partkey") % 7 != 0).alias("is_active"), F.concat("p_name", F.lit(" nÃ©")).alias("raw_name"), gender.alias("declared_gender"))
    vectors = V.table(spark, folder, "embeddings").select(F.col("vec_id").alias("listing_id"), "embedding")
    scanned = tokens.scan_listings(listings.join(vectors, "listing_id", "left"), ("store1", "store2", "store4"))
    return scanned.select("listing_id", "raw_name")


@query("table_versions", """
WITH base AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN price + 1 ELSE price END AS price, CAST(2 AS BIGINT) AS version FROM base""")
def table_versions(spark, folder):
    """Two versions are committed, one of them twice; a third fails half-way and a late writer loses: readers get the second."""
    base = V.table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"))
    table = T.VersionedTable(spark, work_folder(spark, "versions"))
    table.commit(base, "load-1")
    changed = T.merge(table.read(), base.where("l_linenumber % 2 = 0").withColumn("price", F.col("price") + 1), ["l_orderkey", "l_linenumber"]).drop("change")
    table.commit(changed, "load-2", expected=1)
    table.commit(base, "load-2")
    broken = base.withColumn("price", F.when(F.col("l_orderkey") % 10 == 9, F.raise_error(F.lit("disk full"))).otherwise(F.col("price")))
    for late, expected in ((broken, 2), (base.limit(1), 1)):
        try:
            table.commit(late, f"late-{expected}", expected)
        except (T.Conflict, PySparkException):
            continue
        raise AssertionError("a failed or late writer moved the pointer")
    table.clean()
    return table.read().withColumn("version", F.lit(table.version()).cast("bigint"))
