"""Table schemas."""

from __future__ import annotations

# The tables of the catalogue.
PAGES = "page_id bigint, url string, html string"

BRANDS = (
    "id bigint, name string, url string, discovered_at timestamp_ntz, processed_at timestamp_ntz"
)
PRODUCTS = (
    "id bigint, brand_id bigint, url string, name string, brand_name string, "
    "description string, image_url string, rating_value double, rating_count bigint, "
    "categories array<string>, json_ld string, "
    "discovered_at timestamp_ntz, scraped_at timestamp_ntz"
)
PRODUCT_INGREDIENTS = (
    "product_id bigint, position int, ingredient_url string, ingredient_name string, "
    "extra map<string,string>"
)
EXTRACT_FAILURES = "url string, page_id bigint, error string, seen_at timestamp_ntz"
# the newest capture a stream has seen of an address
CAPTURED = "url string, page_id bigint"
TABLES = {
    "brands": BRANDS,
    "products": PRODUCTS,
    "product_ingredients": PRODUCT_INGREDIENTS,
    "extract_failures": EXTRACT_FAILURES,
    "captured": CAPTURED,
    "captures": PAGES,
}
#: What rows of a stored table are dealt by.
KEYS = {**dict.fromkeys(TABLES, "url"), "product_ingredients": "product_id"}
#: Column of a clustered table that tells a row's bucket.
BUCKET = "bucket"
