"""Raw store payloads as product rows: JSON, search responses and HTML, each one a table transform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as X

# fixed values: payload schemas, card patterns, exclusion rules in priority order
SHOP_JSON = ("struct<id:string,title:string,handle:string,body_html:string,vendor:string,product_type:string,"
             "variants:array<struct<price:string,compare_at_price:string,sku:string,available:boolean>>,images:array<struct<src:string>>>")
STORE_API = ("struct<id:string,name:string,slug:string,permalink:string,sku:string,is_in_stock:boolean,prices:struct<price:string,regular_price:string>,"
             "attributes:array<struct<taxonomy:string,terms:array<struct<name:string>>>>,categories:array<struct<slug:string>>,images:array<struct<src:string>>>")
SEARCH_HIT = ("struct<objectID:string,sku:string,name:string,brand:string,direct_discount:string,normal_price:string,options_text:string,slug:string,"
              "catalog_image_url:string,has_stock:boolean>")
SEARCH_PAGE = "struct<total:int,hits:array<struct<productId:string,price:double,image:struct<disBaseLink:string,link:string>>>>"
JSON_LD = "struct<`@type`:string,name:string,url:string,brand:string,image:string,offers:struct<price:string,availability:string>>"

CARD = r'(?s)<article\s+class="theme-block product-block[^"]*"(.*?)</article>'
CARD_FIELDS = {
    "id": r'data-product-id="(\d+)"',
    "path": r'href="(/[^"?#]+)"\s+class="product-block__name"',
    "name": r'class="product-block__name"[^>]*>(.*?)<',
    "sku": r'class="product-block__sku[^"]*">(.*?)<',
    "brand": r'class="product-block__brand[^"]*">(.*?)<',
    "new_price": r'product-block__price--new">(.*?)<',
    "plain_price": r'class="product-block__price">(.*?)<',
    "old_price": r'product-block__price--old">(.*?)<',
    "image": r'<img\s+src="(https://[^"]+)"\s+class="product-block__image"',
    "stock": r'<input[^>]*name="qty"[^>]*max="(\d+)"',
}
REQUIRED_FIELDS = ("id", "path", "name", "price")
PAGE_TOTAL = r"\d+\s*-\s*\d+\s+de\s+(\d+)\s+productos"
PAGE_LINK = r'href="/perfumes\?page=(\d+)"'
SITE_TOTAL = r"^(\d[\d.]*)productos?$"
PLACEHOLDER_IMAGE = r"(?i)/ND\.(jpe?g|png|webp)$"
AVAILABILITY_FILTER = r"^\(timestamp_available_on < \d+\)$"

GIFT_SET = r"\b(?:set|cofre|cofe|estuche|kit)\b|\+"
EXCLUSIONS = {
    # store kind: ordered (reason, column, pattern, needs a gift set: True, False or None)
    "shop_json": [
        ("tester", "all_text", r"\btest(?:er)?\b", None), ("tester", "name", r"\(T\)", None),
        ("decant", "all_text", r"\bdecants?\b|\bfraccionad", None),
        ("not_a_perfume", "product_type", r"^\s*(?:desodorante|crema|ambiental)\s*$", None),
        ("unwrapped", "body", r"\bsin\s+celof[aá]n\b", None),
    ],
    "store_api": [
        ("tester", "name", r"\btester\b", None), ("tester", "slug", r"\btester\b", None), ("decant", "name", r"\bdecants?\b", None),
        ("decant", "categories", r"\bdecants?\b", None), ("refill", "name", r"\brecarga\b|\brefill\b", None),
        ("deodorant", "name", r"\bdesodorante\b|\bdeo\b", False), ("set_with_lotion", "name", r"\bloci[oó]n\b|\blotion\b", True),
        ("not_a_perfume", "name", r"\bjab[oó]n\b", False),
    ],
    "html_card": [
        ("tester", "name", r"\btester\b", None), ("tester", "slug", r"\btester\b", None),
        ("deodorant", "name", r"\bdesodorante\b|\bdeo\b", False), ("set_with_lotion", "name", r"\bloci[oó]n\b|\blotion\b", True),
        ("body_lotion", "name", r"\bloci[oó]n\b|\blotion\b", False),
    ],
}
# end fixed values


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _stock(flag: Column) -> Column:
    return F.when(flag, "available").otherwise(fixed.OUT_OF_STOCK)


def _discounted(price: Column, full: Column) -> Column:
    return F.coalesce(full.try_cast("double") > price.try_cast("double"), F.lit(False))


# ------------------------------------------------------------------ A10, A11, A13: JSON products

def from_shop_json(rows: DataFrame, payload: str = "payload", base_url: str = "") -> DataFrame:
    """Nested shop products: first variant's prices, first image; a list price only above the price."""
    p = rows.withColumn("p", F.from_json(payload, SHOP_JSON))
    v = F.get("p.variants", F.lit(0))
    name = X.squeeze(F.coalesce("p.title", F.lit("")))
    price, full = v["price"], v["compare_at_price"]
    body = F.regexp_replace(F.coalesce("p.body_html", F.lit("")), "<[^>]+>", " ")
    return p.select(
        *rows.columns, name.alias("name"), _blank(F.col("p.vendor")).alias("brand"), X.price_text(price).alias("current_price"),
        F.when(_discounted(price, full), X.price_text(full)).alias("previous_price"), X.extract_volume(name).alias("volume"),
        X.extract_concentration(name).alias("concentration"), F.concat(F.lit(f"{base_url}/products/"), "p.handle").alias("url"),
        F.get("p.images", F.lit(0))["src"].alias("image_url"), _stock(F.coalesce(v["available"], F.lit(False))).alias("availability"),
        _blank(v["sku"]).alias("sku"), _blank(F.col("p.product_type")).alias("product_type"), F.col("p.id").alias("source_id"),
        F.concat_ws(" ", name, body).alias("body"), F.concat_ws(" \n ", name, "p.product_type", "p.handle", body).alias("all_text"))


def attribute_terms(attributes: Column, taxonomy: str) -> Column:
    """Term names of the first attribute of a taxonomy, entities unescaped; empty when absent."""
    found = F.get(F.filter(attributes, lambda a: a["taxonomy"] == taxonomy), F.lit(0))
    return F.coalesce(F.transform(found["terms"], lambda t: F.trim(X.unescape_html(F.coalesce(t["name"], F.lit(""))))), F.array().cast("array<string>"))


def volume_of(name: Column, written: Column) -> tuple[Column, Column]:
    """The size two sources state, and a note when they disagree (then the size is unknown)."""
    a, b = X.extract_volume(name), X.extract_volume(written)
    clash = a.isNotNull() & b.isNotNull() & ~X.to_volume_ml(a).eqNullSafe(X.to_volume_ml(b))
    note = F.when(clash, F.concat(F.lit("name says "), a, F.lit(", format says "), written))
    return F.when(~clash, F.coalesce(a, b)), note


def from_store_api(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Store API products with attribute arrays: brand, format, concentration and declared gender by taxonomy."""
    p = rows.withColumn("p", F.from_json(payload, STORE_API)).withColumn("name", X.squeeze(X.unescape_html(F.coalesce("p.name", F.lit("")))))
    taxonomies = ("pa_marcas", "pa_formato", "pa_concentracion", "pa_genero")
    p = p.withColumn("terms", F.struct(*(attribute_terms(F.col("p.attributes"), t).alias(t) for t in taxonomies)))
    terms = lambda t: F.col(f"terms.{t}")
    size, note = volume_of(F.col("name"), F.get(terms("pa_formato"), F.lit(0)))
    by_term = F.get(F.filter(F.transform(terms("pa_concentracion"), X.extract_concentration), lambda c: c.isNotNull()), F.lit(0))
    price, full = F.col("p.prices.price"), F.col("p.prices.regular_price")
    return p.select(
        *rows.columns, "name", F.get(terms("pa_marcas"), F.lit(0)).alias("brand"), X.price_text(price).alias("current_price"),
        F.when(_discounted(price, full), X.price_text(full)).alias("previous_price"), size.alias("volume"), note.alias("volume_note"),
        F.coalesce(X.extract_concentration(F.col("name")), by_term).alias("concentration"), F.col("p.permalink").alias("url"),
        F.get("p.images", F.lit(0))["src"].alias("image_url"), _stock(F.coalesce("p.is_in_stock", F.lit(False))).alias("availability"),
        _blank(F.col("p.sku")).alias("sku"), F.col("p.id").alias("source_id"), F.when(F.size(terms("pa_genero")) > 0, terms("pa_genero")).alias("declared_gender"),
        F.replace(F.coalesce("p.slug", F.lit("")), F.lit("-"), F.lit(" ")).alias("slug"),
        F.array_join(F.transform("p.categories", lambda c: c["slug"]), " ").alias("categories"))


def from_search_hit(rows: DataFrame, payload: str = "payload", base_url: str = "") -> DataFrame:
    """Search-index hits: the discount is the price when lower; size from option, name, slug; strength from name, slug."""
    p = rows.withColumn("p", F.from_json(payload, SEARCH_HIT)).withColumn("name", F.trim(F.coalesce("p.name", F.lit(""))))
    full, offer = F.col("p.normal_price"), F.col("p.direct_discount")
    on_sale = _discounted(offer, full)
    slug = F.replace(F.coalesce("p.slug", F.lit("")), F.lit("-"), F.lit(" "))
    option = _blank(F.col("p.options_text"))
    return p.select(
        *rows.columns, "name", _blank(F.col("p.brand")).alias("brand"), X.price_text(F.when(on_sale, offer).otherwise(full)).alias("current_price"),
        F.when(on_sale, X.price_text(full)).alias("previous_price"),
        F.coalesce(X.extract_volume(option), X.extract_volume(F.col("name")), X.extract_volume(slug)).alias("volume"),
        F.coalesce(X.extract_concentration(F.col("name")), X.extract_concentration(slug)).alias("concentration"),
        F.concat(F.lit(f"{base_url}/products/"), "p.slug", F.lit("?default_sku="), "p.sku").alias("url"), F.col("p.catalog_image_url").alias("image_url"),
        _stock(F.coalesce("p.has_stock", F.lit(False))).alias("availability"), F.col("p.sku").alias("sku"), option.alias("options_text"), F.col("p.objectID").alias("source_id"))


# ------------------------------------------------------------------ A14: which response is the listing

def listing_results(rows: DataFrame, category: str) -> DataFrame:
    """Multi-query search traffic: the results of listing queries, and `extra`, the filters besides the category.

    rows: capture_id, requests (array of URL parameter texts), results (array of JSON texts). A row with
    a non-empty extra must not be loaded: it is not the whole category.
    """
    pairs = rows.select("capture_id", F.explode(F.arrays_zip("requests", "results")).alias("z")).select(
        "capture_id", F.col("z.requests").alias("params"), F.col("z.results").alias("result"))
    value = lambda k: F.coalesce(F.url_decode(F.regexp_extract("params", rf"(?:^|&){k}=([^&]*)", 1)), F.lit(""))
    facets = value("facetFilters")
    listed = pairs.where(F.contains(facets, F.lit(category)) & (F.coalesce(value("hitsPerPage").try_cast("int"), F.lit(0)) > 0))
    names = F.regexp_extract_all(facets, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    readable = F.rlike(facets, F.lit(r"^\s*\[.*\]\s*$"))
    other = F.when(readable, F.filter(names, lambda n: n != F.lit(f"product_categories.lvl1:{category}"))).otherwise(F.array(F.lit("unreadable facetFilters")))
    filters = value("filters")
    extra = F.array_compact(F.concat(other, F.array(
        F.when((filters != "") & ~F.rlike(filters, F.lit(AVAILABILITY_FILTER)), F.concat(F.lit("filters="), filters)),
        *[F.when(value(k) != "", F.concat(F.lit(f"{k}="), value(k))) for k in ("numericFilters", "tagFilters")])))
    return listed.select("capture_id", "result", extra.alias("extra"))


# ------------------------------------------------------------------ A12: HTML cards

def cards(pages: DataFrame, html: str = "html", card: str = CARD) -> DataFrame:
    """One row per card of a listing page, with its position."""
    others = [c for c in pages.columns if c != html]
    return pages.select(*others, F.posexplode(F.regexp_extract_all(html, F.lit(card), 1)).alias("position", "card"))


def card_fields(rows: DataFrame, fields: dict[str, str] = CARD_FIELDS, required: Sequence[str] = REQUIRED_FIELDS, base_url: str = "") -> DataFrame:
    """Card text to columns; `parsed` is false when a required field is missing."""
    first = lambda k: F.nullif(X.squeeze(X.unescape_html(F.regexp_extract("card", "(?s)" + fields[k], 1))), F.lit(""))
    out = rows.select(*[c for c in rows.columns if c != "card"], *[first(k).alias(k) for k in fields])
    no_space = lambda c: F.nullif(F.regexp_replace(c, " ", ""), F.lit(""))
    if "plain_price" in fields:
        out = out.withColumn("price", no_space(F.coalesce("new_price", "plain_price"))).withColumn(
            "old_price", no_space(F.col("old_price"))).drop("new_price", "plain_price")
    complete = F.lit(True)
    for k in required:
        complete = complete & F.col(k).isNotNull()
    return out.withColumn("parsed", complete).withColumn("url", F.concat(F.lit(base_url), "path")).withColumn(
        "slug", F.replace(F.coalesce("path", F.lit("")), F.lit("-"), F.lit(" ")))


def page_totals(pages: DataFrame, html: str = "html", total: str = PAGE_TOTAL, link: str = PAGE_LINK) -> DataFrame:
    """Announced product total and highest page number of each page."""
    links = F.transform(F.regexp_extract_all(html, F.lit(link), 1), lambda n: n.try_cast("int"))
    return pages.select(*[c for c in pages.columns if c != html], F.nullif(F.regexp_extract(html, total, 1), F.lit("")).try_cast("int").alias("site_total"),
                        F.coalesce(F.array_max(links), F.lit(1)).alias("last_page"))


# ------------------------------------------------------------------ A15: JSON-LD

def json_ld_products(pages: DataFrame, html: str = "html") -> DataFrame:
    """Product blocks of the ld+json scripts; one object or a list, brand and image as text, object or list."""
    others = [c for c in pages.columns if c != html]
    script = r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'
    blocks = pages.select(*others, F.explode(F.regexp_extract_all(html, F.lit(script), 1)).alias("block"))
    listed = F.when(F.startswith(F.trim("block"), F.lit("[")), F.col("block")).otherwise(F.concat(F.lit("["), "block", F.lit("]")))
    items = blocks.select(*others, F.explode(F.from_json(listed, f"array<{JSON_LD}>")).alias("p")).where(F.col("p.`@type`") == "Product")
    brand = F.coalesce(F.get_json_object("p.brand", "$.name"), F.when(~F.startswith("p.brand", F.lit("{")), F.col("p.brand")))
    image = F.when(F.startswith("p.image", F.lit("[")), F.get_json_object("p.image", "$[0]")).otherwise(F.col("p.image"))
    return items.select(*others, F.coalesce("p.name", F.lit("")).alias("name"), _blank(brand).alias("brand"), F.col("p.offers.price").alias("current_price"),
                        F.col("p.url").alias("url"), _blank(image).alias("image_url"), F.col("p.offers.availability").alias("availability"))


# ------------------------------------------------------------------ A16, A17, A19: prices, totals, images

def pick_prices(nodes: Column) -> tuple[Column, Column]:
    """(current, list) from an array of (text, struck): first plain exact price and first struck one."""
    exact = F.filter(nodes, lambda n: F.rlike(n["text"], F.lit(fixed.NODE_PRICE)))
    struck = F.get(F.filter(exact, lambda n: n["struck"]), F.lit(0))["text"]
    plain = F.get(F.filter(exact, lambda n: ~n["struck"]), F.lit(0))["text"]
    return F.coalesce(plain, struck), F.when(plain.isNotNull(), struck)


def site_total(texts: Column) -> Column:
    """The first "497 productos" among page texts, as a number."""
    bare = F.transform(texts, lambda t: F.regexp_replace(t, r"(?U)\s+", ""))
    hit = F.get(F.filter(bare, lambda t: F.rlike(t, F.lit(X.rx(SITE_TOTAL, True)))), F.lit(0))
    return F.replace(F.regexp_extract(hit, X.rx(SITE_TOTAL, True), 1), F.lit("."), F.lit("")).try_cast("int")


def usable_image(url: Column) -> Column:
    """An https photo that is not the store's placeholder."""
    found = X.image_url(url)
    return F.when(~F.rlike(F.regexp_replace(found, r"\?.*$", ""), F.lit(PLACEHOLDER_IMAGE)), found)


def search_pages(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Search responses (url, read_at, payload) with refine and parsed body."""
    refine = F.url_decode(F.regexp_extract("url", r"[?&]refine=([^&#]*)", 1))
    return rows.withColumn("refine", refine).withColumn("page", F.from_json(payload, SEARCH_PAGE))


def search_totals(pages: DataFrame, category: str) -> DataFrame:
    """Category totals: of responses refined by exactly the category; the last one counts, several mean it moved."""
    own = pages.where((F.col("refine") == f"cgid={category}") & F.rlike("url", F.lit(r"/product-search(?:\?|$)")) & (F.col("page.total") >= 0))
    return own.agg(F.max_by("page.total", "read_at").alias("site_total"), F.count_distinct("page.total").alias("totals_seen"))


def search_hits(pages: DataFrame) -> DataFrame:
    return pages.select("read_at", F.explode("page.hits").alias("h")).select(
        "read_at", F.col("h.productId").alias("product_id"), F.col("h.price").alias("price"),
        F.coalesce(usable_image(F.col("h.image.disBaseLink")), usable_image(F.col("h.image.link"))).alias("image_url")).where("product_id <> ''")


def unpriced_hits(hits: DataFrame) -> DataFrame:
    return hits.where("price IS NULL").select("product_id").distinct()


def hit_images(hits: DataFrame) -> DataFrame:
    return hits.where("image_url IS NOT NULL").groupBy("product_id").agg(F.max_by("image_url", "read_at").alias("image_url"))


# ------------------------------------------------------------------ A18: details

def needs_detail(volume: Column, concentration: Column, name: Column) -> Column:
    """A visit is needed when a field is missing and the expanded name does not say the size."""
    return concentration.isNull() | (volume.isNull() & X.extract_volume(X.expand_abbreviations(name)).isNull())


# fixed value: the line of a detail text that states the size
VOLUME_LINE = r"(?i)(?:Contenido|Formato):\s*([^\n]+)"


def enrich(products: DataFrame, details: DataFrame, sources: Sequence[str], volume_line: str = VOLUME_LINE) -> DataFrame:
    """Missing size and concentration from detail texts, sources in order, with where each came from.

    details: url, source, text. Sources are pivoted by conditional aggregates (their number is fixed),
    so a page's texts never form an unbounded list.
    """
    by_url = details.groupBy("url").agg(*[F.max(F.when(F.col("source") == s, F.col("text"))).alias(f"t_{i}") for i, s in enumerate(sources)])
    rows = products.join(by_url, "url", "left")
    strength, origin, size = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, s in reversed(list(enumerate(sources))):
        code = X.extract_concentration(F.col(f"t_{i}"))
        strength, origin = F.coalesce(code, strength), F.when(code.isNotNull(), s).otherwise(origin)
        size = F.coalesce(X.extract_volume(F.nullif(F.regexp_extract(f"t_{i}", volume_line, 1), F.lit(""))), size)
    return rows.select(
        *[c for c in products.columns if c not in ("concentration", "volume")], F.coalesce("concentration", strength).alias("concentration"),
        F.when(F.col("concentration").isNotNull(), "listing").otherwise(origin).alias("concentration_source"),
        F.coalesce("volume", size).alias("volume"),
        F.when(F.col("volume").isNotNull(), "listing").when(size.isNotNull(), "detail").alias("volume_source"))


def enrich_counters(before: DataFrame, after: DataFrame) -> DataFrame:
    """(counter, value) before and after enrichment."""
    pairs = [("volume_before", before, "volume"), ("volume_after", after, "volume"), ("concentration_before", before, "concentration"), ("concentration_after", after, "concentration")]
    rows = None
    for name, df, column in pairs:
        row = df.agg(F.count(column).alias("value")).select(F.lit(name).alias("counter"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows


# ------------------------------------------------------------------ A20, A21, A22

def combine_categories(rows: DataFrame, keys: Sequence[str] = ("file", "url")) -> DataFrame:
    """One row per URL: the first category that shows it wins; how many do, and whether prices differ.

    rows: keys, category (sortable), position, price and other columns.
    """
    rest = [c for c in rows.columns if c not in (*keys, "category", "position")]
    return rows.groupBy(*keys).agg(
        F.min(F.struct("category", "position", *rest)).alias("r"), F.size(F.collect_set("category")).cast("bigint").alias("categories"),
        (F.min("price") != F.max("price")).alias("price_differs")).select(*keys, "r.category", *[F.col(f"r.{c}").alias(c) for c in rest], "categories", "price_differs")


def exclusion(kind: str) -> Column:
    """Why a product is not loaded, first rule that fires; null keeps it."""
    gift = X.matches(F.col("name"), GIFT_SET)
    chain = None
    for reason, column, pattern, needs_set in EXCLUSIONS[kind]:
        test = F.coalesce(X.matches(F.col(column), pattern), F.lit(False))
        if needs_set is not None:
            test = test & (gift if needs_set else ~gift)
        chain = F.when(test, reason) if chain is None else chain.when(test, reason)
    return chain


def walk_counts(rows: DataFrame, key: str = "source_id") -> DataFrame:
    """Products seen, excluded by reason and kept, over distinct ids in reading order. rows: key, position, reason."""
    first = rows.groupBy(key).agg(F.min(F.struct("position", "reason")).alias("r"))
    return first.groupBy(F.coalesce("r.reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("products"))
