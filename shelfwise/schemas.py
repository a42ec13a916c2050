"""Schemas of the documents and tables. Nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

_s, _i, _b, _t = T.StringType(), T.IntegerType(), T.BooleanType(), T.TimestampType()
_strings = T.ArrayType(_s)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


PRODUCT = _struct(
    name=_s, brand=_s, current_price=_s, previous_price=_s, volume=_s, concentration=_s, url=_s, image_url=_s,
    availability=_s, sku=_s, volume_note=_s, declared_gender=_strings, stock=_i)
CATEGORY = _struct(
    category_url=_s, site_total=_i, listing_complete=_b, catalog_exhausted=_b, urls_distinct=_i, error=_s,
    batch_ends=T.ArrayType(_i), listing_source=_s, recovered=_strings)
PAGINATION = _struct(
    stop_reason=_s, catalog_exhausted=_b, site_total=_i, products_seen=_i, final_products=_i, pages_read=_i, total_pages=_i,
    empty_page=_i, unparsed_cards=_i, excluded=T.MapType(_s, _i), pages_fetched=_i, page_size=_i, site_total_reported=_i,
    unpriced_in_api=_strings, urls_distinct=_i, in_several_categories=_i, listing_complete=_b, categories=T.ArrayType(CATEGORY))
SNAPSHOT = _struct(
    store=_s, category_url=_s, scraped_at=_s, price_extraction_version=_i,
    progress=_struct(step=_s, url=_s, updated_at=_s), failures=T.ArrayType(_struct(step=_s, url=_s, error=_s)),
    pagination=PAGINATION, products=T.ArrayType(PRODUCT), part=_i, parts=_i)  # a large snapshot comes in `parts` files, numbered from 1

LISTINGS = _struct(
    listing_id=_s, store=_s, product_id=_s, store_sku=_s, listing_url=_s, raw_name=_s, raw_brand=_s,
    embedding=T.ArrayType(T.FloatType()), matching_status=_s, match_confidence=T.DecimalType(4, 3), first_seen_at=_t,
    last_seen_at=_t, is_active=_b, parsed_concentration=_s, parsed_volume_ml=_i, image_url=_s, declared_gender=_s)
PRICES = _struct(listing_id=_s, price=T.LongType(), list_price=T.LongType(), currency=_s, is_available=_b, scraped_at=_t)
RUN_STORES = _struct(
    run_id=T.LongType(), store=_s, file=_s, scraped_at=_t, is_backfill=_b, status=_s, stop_reason=_s, products_scraped=T.LongType(),
    prices_added=T.LongType(), notes=_strings, error=_s)
ALLOWED = {
    "gender": ("male", "female", "unisex"),
    "concentration": ("parfum", "edp", "edt", "cologne", "eau_fraiche", "other"),
    "presentation": ("full_bottle", "travel_size", "tester", "refill", "travel_set"),
    "matching_status": ("pending", "matched", "new_product"),
    "run_status": ("running", "ok", "partial", "failed"),
}
