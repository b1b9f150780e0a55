"""Merges, queues, the store, whole jobs and the stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from catalograft.operators import fetchlog, merges, queues
from catalograft.plans import jobs
from catalograft.schemas import BRANDS, PRODUCT_INGREDIENTS, PRODUCTS
from catalograft.sources import storage_json
from catalograft.sources.pages import current, decode_captures, lookup_pages, stream_pages
from catalograft.sources.store import CatalogStore
from catalograft.streaming import ingest
from catalograft.streaming.ingest import ingest_stream

B = "https://shop.example"
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 6, 1, 12, 0, 0, 5)
T1S = T1.replace(microsecond=0)
EXTRACTED = (
    "page_id bigint, url string, name string, brand string, description string, image_url string, "
    "rating_value double, rating_count bigint, categories array<string>, json_ld string"
)


def product(id_, url, name=None, brand_id=None, brand=None, description=None, scraped=None):
    return (id_, brand_id, url, name, brand, description, None, None, None, None, None, T0, scraped)


def by_url(df):
    return {r["url"]: r for r in df.collect()}


def test_merge_brands(spark):
    old = spark.createDataFrame([(1, "A", "u", T0, None), (2, "K", "k", T0, T0)], BRANDS)
    batch = spark.createDataFrame(
        [(1, "B", "u"), (2, "", "u"), (3, "A", "n"), (4, "B", "n"), (5, "", "e"), (6, "", "k")],
        "ord int, name string, url string",
    )
    merged = merges.merge_brands(old, batch, T1)
    rows = by_url(merged)
    assert (rows["u"]["name"], rows["u"]["discovered_at"], rows["u"]["action"]) == ("B", T0, "update")
    assert (rows["n"]["id"], rows["n"]["name"], rows["n"]["discovered_at"]) == (3, "B", T1S)
    assert (rows["e"]["id"], rows["e"]["name"]) == (4, "")
    assert (rows["k"]["name"], rows["k"]["processed_at"], rows["k"]["action"]) == ("K", T0, "keep")
    assert merges.inserted_count(merged).first()["inserted"] == 2


def test_merge_queued_products(spark):
    brands = spark.createDataFrame([(1, "One", "1", T0, None), (2, "Two", "2", T0, None), (3, "", "3", T0, None)], BRANDS)
    old = spark.createDataFrame([product(1, "m4", "A", 1, "One"), product(2, "m5"), product(3, "same", "S")], PRODUCTS)
    batch = spark.createDataFrame(
        [(1, 2, "m4", "B"), (2, 1, "m5", "B"), (3, 3, "m5", "C"), (4, 1, "new", None), (5, 2, "new", "N")],
        "ord int, brand_id bigint, url string, name string",
    )
    rows = by_url(merges.merge_queued_products(old, batch, brands, T1))
    assert [rows["m4"][c] for c in ("name", "brand_id", "brand_name")] == ["A", 2, "Two"]
    assert [rows["m5"][c] for c in ("name", "brand_id", "brand_name")] == ["B", 3, "One"]
    assert [rows["new"][c] for c in ("id", "name", "brand_id", "brand_name")] == [4, "N", 2, "Two"]
    assert rows["same"]["action"] == "keep"


def test_merge_products(spark):
    old = spark.createDataFrame(
        [product(1, "m6", "A", 7, "Br", "d"), product(2, "m7", "A"), product(3, "keep", "K", description="d")], PRODUCTS
    )
    batch = spark.createDataFrame(
        [(1, "m6", None, None, None, None, 1.5, 2, ["c"], "{}"), (2, "m7", "", "", "x", None, None, None, [], None),
         (3, "m9", "N", None, None, None, None, None, [], None)],
        EXTRACTED,
    )
    rows = by_url(merges.merge_products(old, batch, T1))
    assert [rows["m6"][c] for c in ("name", "brand_name", "description", "brand_id", "rating_value", "scraped_at", "discovered_at")] == ["A", "Br", None, 7, 1.5, T1S, T0]
    assert [rows["m7"][c] for c in ("name", "brand_name", "description")] == ["", "", "x"]
    assert [rows["m9"][c] for c in ("id", "brand_id", "discovered_at", "scraped_at")] == [4, None, T1S, T1S]
    assert (rows["keep"]["description"], rows["keep"]["scraped_at"]) == ("d", None)


def test_replace_ingredients_clears_empty_rosters(spark):
    old = spark.createDataFrame([(1, 1, "x", "X", {}), (1, 2, "y", "Y", {}), (2, 1, "z", "Z", {})], PRODUCT_INGREDIENTS)
    saved = spark.createDataFrame(
        [(1, [])], "product_id bigint, ingredients array<struct<position:int,name:string,url:string,extra:map<string,string>>>"
    )
    assert [(r["product_id"], r["ingredient_name"]) for r in merges.replace_ingredients(old, saved).collect()] == [(2, "Z")]


def test_queues(spark):
    table = spark.createDataFrame([product(2, "b"), product(1, "a"), product(3, "c", scraped=T0)], PRODUCTS)
    assert [r["id"] for r in queues.product_queue(table).collect()] == [1, 2]
    assert [r["id"] for r in queues.product_queue(table, resume=False).collect()] == [1, 2, 3]
    assert [r["url"] for r in queues.pending(table.select("url"), table).orderBy("url").collect()] == ["a", "b"]
    pages = spark.createDataFrame([(1, "bad"), (2, None), (3, None), (4, None)], "id int, extract_error string")
    assert [r["id"] for r in queues.take_success(pages, 2, "id").collect()] == [2, 3]
    assert queues.take_success(pages, 0, "id").count() == 0


def test_storage_json_round_trip(spark):
    df = spark.createDataFrame([(1, ["é\"", "b"], '{"a":1}'), (2, [], ""), (3, None, None)], "id int, categories array<string>, json_ld string")
    stored = storage_json.to_storage_json(df)
    assert [(r["categories"], r["json_ld"]) for r in stored.orderBy("id").collect()] == [
        ('["\\u00e9\\"", "b"]', '{"a":1}'), ("[]", None), ("[]", None)
    ]
    assert [r["categories"] for r in storage_json.from_storage_json(stored).orderBy("id").collect()] == [["é\"", "b"], [], []]
    extra = spark.createDataFrame([(1, {"k": "é"}), (2, {}), (3, None)], "id int, extra map<string,string>")
    text = storage_json.to_storage_extra(extra)
    assert [r["extra"] for r in text.orderBy("id").collect()] == ['{"k": "é"}', None, None]
    assert [r["extra"] for r in storage_json.from_storage_extra(text).orderBy("id").collect()] == [{"k": "é"}, {}, {}]


def test_captures_and_lookup(spark):
    captures = spark.createDataFrame(
        [(1, "a", 200, b"\xc3\xa9\xff", None), (2, "b", 200, "é".encode("cp1252"), "windows-1252"), (3, "c", 404, b"x", None), (4, "a", 200, b"new", "utf-8")],
        "page_id bigint, url string, status int, body binary, charset string",
    )
    pages = decode_captures(captures)
    assert {r["page_id"]: r["html"] for r in pages.collect()} == {1: "é�", 2: "é", 3: None, 4: "new"}
    asked = spark.createDataFrame([("a",), ("c",), ("z",)], "url string")
    assert {r["url"]: (r["html"], r["found"]) for r in lookup_pages(asked, pages).collect()} == {
        "a": ("new", True), "c": (None, False), "z": (None, False)
    }


NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


@pytest.fixture(scope="module")
def site(spark):
    def page(i):
        if i == 1:
            return "<script type>x</script>"  # an error page
        return f'<h1>P{i}</h1><a href="/ingredients/w">Water</a><a href="/ingredients/i{i}">I{i}</a>'

    locs = "".join(f"<url><loc>{B}/products/{i}</loc></url>" for i in range(1, 7))
    rows = {
        "/sitemap.xml": f'<sitemapindex xmlns="{NS}"><sitemap><loc>{B}/products.xml</loc></sitemap></sitemapindex>',
        "/products.xml": f'<urlset xmlns="{NS}">{locs}</urlset>',
        "/brands?offset=0": '<a href="/brand/b-one">One</a><a href="/brand/b-two"></a>',
        "/brand/b-one": '<a href="/products/1">n1</a><a href="/products/2"></a><a href="?page=2">2</a>',
        "/brand/b-one?page=2": '<a href="/products/3">n3</a><a href="?page=1">1</a>',
        "/brand/b-two": '<a href="/products/4">n4</a><a href="/products/9">gone</a>',
        **{f"/products/{i}": page(i) for i in range(1, 6)},
    }
    data = [(i, B + u, h) for i, (u, h) in enumerate(rows.items())]
    return spark.createDataFrame(data, "page_id bigint, url string, html string")


def stored(store):
    rows = queues.read_products(store.read("products"), store.read("product_ingredients")).collect()
    return {r["url"].rsplit("/", 1)[1]: r for r in rows}


def test_brand_job(spark, site, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    jobs.run(store, site, B, T1)
    rows = stored(store)
    assert sorted(rows) == ["2", "3", "4"]
    assert (rows["2"]["name"], rows["2"]["brand"]) == ("P2", "One")
    assert rows["4"]["brand"] == "B Two"
    assert [i["name"] for i in rows["3"]["ingredients"]] == ["Water", "I3"]
    queued = by_url(store.read("products"))
    assert queued[f"{B}/products/1"]["scraped_at"] is None
    assert (queued[f"{B}/products/9"]["name"], queued[f"{B}/products/2"]["brand_id"]) == ("gone", 1)
    assert {r["processed_at"] for r in store.read("brands").collect()} == {T1S}
    later = dt.datetime(2024, 7, 1)
    jobs.run(store, site, B, later)
    assert {r["scraped_at"] for r in store.read("products").collect()} == {None, T1S}
    jobs.run(store, site, B, later, resume=False)
    assert {r["scraped_at"] for r in store.read("products").collect()} == {None, later}
    assert {r["processed_at"] for r in store.read("brands").collect()} == {T1S}


@pytest.mark.parametrize("limit, expected", [(0, []), (2, ["2", "3"]), (None, ["2", "3", "4", "5"])])
def test_sitemap_job_limit_counts_successes(spark, site, tmp_path, limit, expected):
    store = CatalogStore(spark, str(tmp_path))
    jobs.run(store, site, B, T1, strategy="sitemap", limit=limit)
    assert sorted(stored(store)) == expected
    if limit == 2:
        jobs.run(store, site, B, T1, strategy="sitemap", limit=1)
        assert sorted(stored(store)) == ["2", "3", "4"]


def test_a_limited_job_parses_each_body_once(spark, site, tmp_path, monkeypatch):
    parsed = []
    extract = jobs.extract_products

    def spied(pages, *args):
        parsed.append([r["url"] for r in pages.select("url").collect()])
        return extract(pages, *args)

    monkeypatch.setattr(jobs, "extract_products", spied)
    monkeypatch.setattr(jobs, "_FIRST_LOOK", 1)
    store = CatalogStore(spark, str(tmp_path))
    jobs.run(store, site, B, T1, strategy="sitemap", limit=3)
    assert sorted(stored(store)) == ["2", "3", "4"]
    urls = [u for stretch in parsed for u in stretch]
    assert len(parsed) > 1 and len(urls) == len(set(urls))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 9])
def test_take_success_cuts_inside_ties_and_nulls(spark, n):
    rows = [(1, None), (1, None), (1, "bad"), (None, None), (2, None), (2, None), (3, None)]
    pages = spark.createDataFrame(rows, "at int, extract_error string").repartition(3)
    got = [r["at"] for r in queues.take_success(pages, n, "at").collect()]
    assert sorted(got, key=lambda a: a or 0) == [None, 1, 1, 2, 2, 3][:n]


def test_stream_equals_batch_and_repeats_change_nothing(spark, site, tmp_path):
    folder = str(tmp_path / "pages")
    site.repartition(3).write.parquet(folder)
    store = CatalogStore(spark, str(tmp_path / "store"))
    for progress in ("p1", "p2"):  # a lost stream checkpoint repeats the batch numbers
        source = stream_pages(spark, folder, files_per_batch=2)
        ingest_stream(source, store, B, str(tmp_path / progress), lambda: T1).awaitTermination()
    rows = stored(store)
    assert sorted(rows) == ["2", "3", "4", "5"]
    assert [i["name"] for i in rows["5"]["ingredients"]] == ["Water", "I5"]
    # a page that arrives with a new progress folder is saved, one under another path too
    new = [(50, f"{B}/products/50", "<h1>P50</h1>"), (51, f"{B}/fr/products/51", "<h1>P51</h1>"), (52, f"{B}/products/52", "<script type>x</script>")]
    spark.createDataFrame(new, "page_id bigint, url string, html string").write.mode("append").parquet(folder)
    source = stream_pages(spark, folder, files_per_batch=100)
    query = ingest_stream(source, store, B, str(tmp_path / "p3"), lambda: T1)
    query.awaitTermination()
    assert sorted(stored(store)) == ["2", "3", "4", "5", "50", "51"]
    assert store.last_batch(f"ingest:{query.id}") == 0
    failures = {r["url"].rsplit("/", 1)[1] for r in store.read("extract_failures").collect()}
    assert failures == {"1", "52"}


def test_jobs_report_and_quarantine(spark, site, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    first = jobs.run(store, site, B, T1)
    assert (first.inserted, first.queued, first.stored, first.failed) == (7, 5, 3, 1)
    row = store.read("extract_failures").first()
    assert (row["url"], row["seen_at"]) == (f"{B}/products/1", T1S) and row["error"]
    second = jobs.run(store, site, B, T1, strategy="sitemap")
    assert (second.stored, second.failed) == (1, 1) and store.read("extract_failures").count() == 1


def test_newest_capture_without_body_means_missing(spark, site, tmp_path):
    lost = spark.createDataFrame([(1_000, f"{B}/products/2", None), (1_001, f"{B}/products/3", "<h1>newer</h1>")], "page_id bigint, url string, html string")
    store = CatalogStore(spark, str(tmp_path))
    jobs.run(store, site.unionByName(lost), B, T1, strategy="sitemap")
    rows = stored(store)
    assert sorted(rows) == ["3", "4", "5"] and rows["3"]["name"] == "newer"


def test_of_two_writers_one_fails(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    one, other = store.begin(), store.begin()
    one.write("brands", spark.createDataFrame([(1, "A", "u", T0, None)], BRANDS))
    other.write("brands", spark.createDataFrame([(2, "B", "v", T0, None)], BRANDS))
    one.commit()
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        other.commit()
    assert [r["name"] for r in store.read("brands").collect()] == ["A"]


def test_unknown_charsets_and_ascii(spark):
    captures = spark.createDataFrame(
        [(1, "a", 200, b"x", "no-such"), (2, "b", 200, b"x", "base64"), (3, "c", 200, b"a\xc3\xa9", "US-ASCII")],
        "page_id bigint, url string, status int, body binary, charset string",
    )
    assert [r["html"] for r in decode_captures(captures).orderBy("page_id").collect()] == [None, None, "a\ufffd\ufffd"]


def test_rosters_with_equal_and_missing_positions(spark):
    products = spark.createDataFrame([product(1, "/p", scraped=T0)], PRODUCTS)
    rows = [(1, None if i % 7 == 0 else i % 5, f"u{i}", f"n{i}", None) for i in range(400)]
    found = queues.read_products(products, spark.createDataFrame(rows, PRODUCT_INGREDIENTS)).first()["ingredients"]
    positions = [i["position"] for i in found]
    assert len(positions) == 400 and positions == sorted(positions, key=lambda p: (p is None, p or 0))


def test_uncommitted_version_is_invisible(spark, tmp_path):
    store = CatalogStore(spark, str(tmp_path))
    version = store.begin()
    version.write("brands", spark.createDataFrame([(1, "A", "u", T0, None)], BRANDS))
    assert store.read("brands").count() == 0
    version.commit()
    assert store.read("brands").count() == 1


def test_fetch_log(spark):
    log = spark.createDataFrame(
        [("a", 1, 503, T0), ("a", 2, 200, T1), ("b", 3, 429, T0), ("c", 4, None, T0), ("d", 1, None, T0), ("e", 1, 204, T0)],
        "url string, attempt int, status int, ts timestamp",
    )
    got = {r["url"]: (r["state"], r["backoff_seconds"]) for r in fetchlog.triage_fetch_log(log).collect()}
    assert got == {"a": ("ok", None), "b": ("retry", 4.0), "c": ("gave_up", None), "d": ("retry", 1.0), "e": ("gave_up", None)}
    start = dt.datetime(2024, 1, 1, 0, 59, 59)
    times = [start, start + dt.timedelta(seconds=0.5), start + dt.timedelta(seconds=1.2), start + dt.timedelta(seconds=9)]
    rows = spark.createDataFrame([("h", t, i) for i, t in enumerate(times)], "host string, ts timestamp, url int")
    gaps = {r["url"]: round(r["gap_seconds"], 3) for r in fetchlog.politeness_gaps(rows).collect()}
    assert gaps == {1: 0.5, 2: 0.7}


def test_a_null_page_id_counts_if_it_is_the_only_capture(spark):
    pages = spark.createDataFrame([(None, "a", "x"), (None, "b", "old"), (3, "b", "new"), (None, "c", None)], "page_id bigint, url string, html string")
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "url string")
    assert {r["url"]: r["html"] for r in lookup_pages(asked, pages).collect()} == {"a": "x", "b": "new", "c": None}


def test_a_stream_moves_bodies_once(spark):
    """The bodies of a batch are chosen as `current` chooses them, by one join."""
    rows = [("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("b", 3, "y"), ("c", None, "z"), ("d", 1, "old"), ("d", 4, "new")]
    pages = spark.createDataFrame(rows, "url string, page_id long, html string")
    fresh = pages.groupBy("url").agg(F.max("page_id").alias("page_id")).where("url <> 'e'").localCheckpoint()
    found = ingest.bodies_of(fresh, pages)
    wanted = current(pages.join(fresh, "url", "left_semi"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, wanted.select(*found.columns).collect()), key=str)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_a_long_batch_of_single_captures_moves_no_body(spark, tmp_path):
    captures = spark.range(4_000).select(
        F.concat(F.lit("https://shop.example/products/"), "id").alias("url"), F.col("id").alias("page_id"),
        F.concat(F.lit("body "), "id").alias("html"),
    )
    odd = [("u", 1, "old"), ("u", 2, "new"), ("u", 2, "again"), ("v", None, "alone"), ("v", None, None), ("w", 3, "passed"), (None, 4, "x")]
    captures.unionByName(spark.createDataFrame(odd, "url string, page_id long, html string")).write.parquet(f"{tmp_path}/pages")
    pages = spark.read.parquet(f"{tmp_path}/pages")
    fresh = pages.groupBy("url").agg(F.max("page_id").alias("page_id")).where("url is not null and url <> 'w'")
    fresh.write.parquet(f"{tmp_path}/fresh")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        # the fresh addresses are too many to be sent to every task
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
        found = ingest.bodies_of(spark.read.parquet(f"{tmp_path}/fresh"), pages)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r["url"], r["html"]) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert [r for r in rows if len(r[0]) == 1] == [("u", "again"), ("u", "new"), ("v", "alone")]
    assert len(rows) == 4_003


def test_rosters_are_ordered_without_a_comparator(spark):
    products = spark.createDataFrame([(1, "u")], "id long, url string").selectExpr(
        "id", "url", "'n' name", "'b' brand_name", "'d' description", "'i' image_url", "1D rating_value", "1L rating_count",
        "array('c') categories", "'{}' json_ld", "now() scraped_at",
    )
    entries = spark.createDataFrame([(1, None, "z"), (1, 2, "b"), (1, 2, "c"), (1, 1, "a")], "product_id long, position int, ingredient_name string")
    entries = entries.selectExpr("*", "'u' ingredient_url", "map('k', 'v') extra").coalesce(1)
    found = queues.read_products(products, entries)
    assert [i["name"] for i in found.first()["ingredients"]] == ["a", "b", "c", "z"]
    assert "lambdafunction(CASE WHEN" not in found._jdf.queryExecution().optimizedPlan().toString()
