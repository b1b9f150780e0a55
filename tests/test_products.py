"""Product extraction against hand-written pages."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from catalograft.functions import jsonld
from catalograft.operators import products
from catalograft.operators.products import PARTS_OF, extract_products

B = "https://shop.example"


def ld(**node):
    return block({"@type": "Product", **node})


def block(document):
    text = document if isinstance(document, str) else json.dumps(document)
    return f'<script type="application/ld+json">{text}</script>'


CASES = {
    "full": f"""
      <!DOCTYPE html><html lang="fr"><head><title>ignored</title>
        <meta name="twitter:image" content="/late.png"><meta name="og:title" content="never used">
        {block([{"@type": "BreadcrumbList"}, {"@type": "ProductGroup", "name": "Crème 12 %",
                "brand": "Maison Verte", "image": ["https://img.example/a.webp", "b"],
                "aggregateRating": {"ratingValue": 3, "ratingCount": "1_204"}, "category": "Soins",
                "ingredients": "Aqua, Squalane , Panthenol"}])}
      </head><body><h1>Une <em>autre</em> page</h1>
        <p><a href="/brand/maison-verte?ref=1">Maison</a> <a title="Squalane" href="/ingredients/squalane-oil">S.</a></p>
        <a href="/ingredients/rice-bran"></a></body></html>""",
    "e1": "<h1>One</h1><h1>Two</h1><h1> </h1>",
    "e2": '<meta name="twitter:title" content="t"><meta property="og:title" content="o">',
    "e3": "<h1> A <b>b</b> </h1>",
    "e4": '<meta property="og:title" content="a"><meta property="OG:title " content=" b ">',
    "e5": '<a href="/brands/x-y">First</a><a href="/brands/a">Second</a>',
    "e6": '<a href="/brand/z-b"></a><a href="/brand/a-c"><img></a>',
    "e7": block("{bad json Product") + ld(name="ok"),
    "e8": block({"@graph": [{"@type": "WebPage"}, {"@type": "Product", "name": "inner"}]}),
    "e9": block('{"z":{"@type":"Product","name":"zed"},"a":{"@type":"Product","name":"ay"}}'),
    "e10": block({"@type": ["Product"], "name": "x"}),
    "e10b": block({"@type": ["Thing"]}) + ld(name="x"),
    "e11a": ld(name="n", aggregateRating={"ratingCount": "18.0"}),
    "e11b": ld(name="n", aggregateRating={"ratingCount": "1,024"}),
    "e11c": ld(name="n", aggregateRating={"ratingCount": 18.7, "ratingValue": 4}),
    "e11d": ld(name="n", aggregateRating={"ratingCount": " 18 ", "ratingValue": "1_8.5"}),
    "e11e": block('{"@type":"Product","aggregateRating":{"ratingCount":1e999}}'),
    "e12": ld(name="n", aggregateRating={"ratingValue": "4,6"}),
    "e12b": ld(name="n", aggregateRating={"ratingValue": "4.6d", "ratingCount": True}),
    "e13a": ld(image=[]) + '<meta property="og:image" content="og">',
    "e13b": ld(image=["u", "v"]) + '<meta property="og:image" content="og">',
    "e13c": ld(image="u"),
    "e14": ld(category=5),
    "e14b": ld(category="one"),
    "e14c": ld(category=["a", 1, None, True]),
    "e15": ld(ingredients="Water, ,Glycerin"),
    "e16": ld(hasIngredient=[], ingredient=["A"]),
    "e17": '<a href="/ingredients/w" data-name="D">T</a>',
    "e18": '<a href="/ingredients/w">T</a><a href="/ingredients/w" data-name="D"></a>',
    "e19": '<a href="/ingredients/green-tea"></a><a href="/ingredients/green-tea/"></a>',
    "e20": '<a href="/ingredients/a">X</a><a href="/ingredients/b">x</a>',
    "e21": ld(ingredients=["Glycerin"]) + '<a href="/ingredients/g">Glycerin</a>',
    "e22": '<a href="/ingredients/Water">W1</a><a href="/ingredients/water">W2</a>',
    "e23": "<script type>x</script><h1>t</h1>",
    "e24": "",
    "entities": "<h1>R&amp;D &eacute;&#233; &notit;</h1>",
    "empty_url": ld(ingredients=[{"name": "a", "url": ""}, {"name": "b"}, {"@id": "/i/c"}, {"x": 1}, 7]),
    "number_name": ld(ingredients=[{"name": 5}]),
    "reset": '<a href="/ingredients/a">A<a href="/x">y</a> z</a>',
    "title_label": '<a title="Lab" href="/ingredients/a#f">A</a>',
    "brand_meta": '<meta name="brand:text" content="M"><a href="/brands">Brands</a>',
    "brand_nav": '<a href="/brands">Brands</a>',
    "falsy": ld(name="", description=0, brand="", image=False) + "<h1>H</h1>",
    "duplicate_keys": block('{"@type":"Thing","@type":"Product","name":"dup"}'),
    "nan": block('{"@type":"Product","name":"n","aggregateRating":{"ratingValue":NaN}}'),
    "trailing": block('{"@type":"Product","name":"bad"} x') + ld(name="good"),
    "two_roots": block('{"@type":"Product","name":"bad"},{"a":1}') + ld(name="good"),
    "surrogate": block('{"a":[{"@type":"Product","name":"s","q":"\\ud800"}]}'),
    "group": block({"@type": "ProductGroup", "name": "grp"}),
    "huge_count": block('[{"@type":"Product","name":"odd","ingredients":["Aqua"],"aggregateRating":{"ratingCount":1e999}}]'),
    "word_count": block('[{"@type":"Product","name":"odd","ingredients":["Aqua"],"aggregateRating":{"ratingCount":Infinity}}]'),
    "huge_other": block('[{"@type":"Product","name":"odd","ingredients":["Aqua"],"weight":-1e999}]'),
    "long_number": block('[{"@type":"Product","name":"odd","ingredients":["Aqua"],"gtin":%s}]' % ("7" * 1200)),
    "long_root": block('{"@type":"Product","name":"odd","ingredients":["Aqua"],"gtin":%s}' % ("7" * 1200)),
    "unclosed": '<h1>T</h1><script type="application/ld+json">{"@type":"Product"}',
}


@pytest.fixture(scope="module")
def out(spark):
    rows = [(i, k, v) for i, (k, v) in enumerate(CASES.items())] + [(999, "null_html", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    return {r["url"]: r for r in extract_products(pages, B).collect()}


def roster(row):
    return [(i["position"], i["name"], i["url"].removeprefix(B)) for i in row["ingredients"]]


def test_every_source_of_a_page_counts(out):
    page = out["full"].asDict()
    wanted = {
        "name": "Crème 12 %", "brand": "Maison Verte", "description": None, "image_url": "https://img.example/a.webp",
        "rating_value": 3.0, "rating_count": 1204, "categories": ["Soins"], "extract_error": None,
    }
    assert {k: page[k] for k in wanted} == wanted
    # anchors come first, and a name met again in the list keeps its place
    assert [name for _, name, _ in roster(page)] == ["S.", "Rice Bran", "Aqua", "Squalane", "Panthenol"]
    assert [p.rsplit("/", 1)[1].split("?")[0] for p in page["raw_brand_links"]] == ["maison-verte"]


@pytest.mark.parametrize(
    "case, error", [("huge_count", True), ("word_count", True), ("huge_other", False), ("long_number", False), ("long_root", False)]
)
def test_numbers_no_double_holds(out, case, error):
    page = out[case]
    assert bool(page["extract_error"]) == error and page["name"] == "odd"
    assert roster(page) == [(1, "Aqua", "")]


@pytest.mark.parametrize(
    "case, name",
    [("e1", "Two"), ("e2", "o"), ("e3", "A b"), ("e4", "b"), ("e7", "ok"), ("e8", "inner"),
     ("e9", "zed"), ("e24", None), ("entities", "R&D éé ¬it;"), ("falsy", "H"),
     ("duplicate_keys", "dup"), ("trailing", "good"), ("two_roots", "good"), ("surrogate", "s"),
     ("group", "grp"), ("unclosed", "T")],
)
def test_name(out, case, name):
    assert out[case]["name"] == name
    assert out[case]["extract_error"] is None


@pytest.mark.parametrize(
    "case, brand",
    [("e5", "First"), ("e6", "A C"), ("brand_meta", "M"), ("brand_nav", "Brands"), ("falsy", ""), ("e1", None)],
)
def test_brand(out, case, brand):
    assert out[case]["brand"] == brand


@pytest.mark.parametrize(
    "case, value, count",
    [("e11a", None, None), ("e11b", None, None), ("e11c", 4.0, 18), ("e11d", 18.5, 18),
     ("e12", None, None), ("e12b", None, 1)],
)
def test_rating(out, case, value, count):
    assert (out[case]["rating_value"], out[case]["rating_count"]) == (value, count)


def test_nan_rating(out):
    assert out["nan"]["rating_value"] != out["nan"]["rating_value"]


@pytest.mark.parametrize("case", ["e10", "e10b", "e11e", "e23", "number_name"])
def test_page_errors(out, case):
    assert out[case]["extract_error"]


@pytest.mark.parametrize("case, image", [("e13a", "og"), ("e13b", "u"), ("e13c", "u"), ("falsy", None)])
def test_image(out, case, image):
    assert out[case]["image_url"] == image


@pytest.mark.parametrize(
    "case, categories", [("e14", []), ("e14b", ["one"]), ("e14c", ["a", "1", "None", "True"]), ("e24", [])]
)
def test_categories(out, case, categories):
    assert out[case]["categories"] == categories


@pytest.mark.parametrize(
    "case, expected",
    [("e15", [(1, "Water", ""), (2, "Glycerin", "")]),
     ("e16", [(1, "A", "")]),
     ("e17", [(1, "T", "/ingredients/w")]),
     ("e18", [(1, "D", "/ingredients/w")]),
     ("e19", [(1, "Green Tea", "/ingredients/green-tea"), (2, "", "/ingredients/green-tea/")]),
     ("e20", [(1, "X", "/ingredients/a")]),
     ("e21", [(1, "Glycerin", "/ingredients/g")]),
     ("e22", [(1, "W2", "/ingredients/Water")]),
     ("e24", []),
     ("reset", []),
     ("title_label", [(1, "A", "/ingredients/a#f")]),
     ("empty_url", [(1, "a", "/"), (2, "b", ""), (3, "/i/c", "/i/c")])],
)
def test_roster(out, case, expected):
    assert roster(out[case]) == expected


def test_page_without_body_gives_no_row(out):
    assert "null_html" not in out


def test_fields_asked_for_decide_what_is_built(spark):
    rows = [(i, f"{B}/{c}", html) for i, (c, html) in enumerate(CASES.items())]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    everything = extract_products(pages, B)
    rows = {r["page_id"]: r for r in everything.collect()}

    def plan_of(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    for fields in [(f,) for f in PARTS_OF] + [("name", "ingredients"), ("rating_value", "extract_error"), ()]:
        some = extract_products(pages, B, fields=fields)
        assert some.columns == ["page_id", "url", *fields]
        found = some.collect()
        assert len(found) == len(rows)
        for r in found:
            assert str([r[f] for f in fields]) == str([rows[r["page_id"]][f] for f in fields])
    rating = plan_of(extract_products(pages, B, fields=("rating_value", "rating_count")))
    assert not any(part in rating for part in ("events", "anchors", "headings", "_groups", "_names"))
    assert "_groups" in plan_of(everything) and "anchors" in plan_of(everything)
    links = plan_of(extract_products(pages, B, fields=("raw_brand_links",)))
    assert "json" not in links and "marks" not in links


LISTS = {
    # decided without a walk: text keeps the order of its members
    '[{"@type":"WebPage"},{"@type":"Product","name":"b","brand":"a"}]': ("root", '{"@type":"Product","name":"b","brand":"a"}'),
    '{"@context":"x","@graph":[{"@type":"ProductGroup","z":1,"a":"é"}]}': ("root", '{"@type":"ProductGroup","z":1,"a":"é"}'),
    '{"@graph":[{"@type":"Organization"},{"@type":"Product","name":"1"},{"@type":"Product","name":"2"}]}': ("root", '{"@type":"Product","name":"1"}'),
    # something before or beside it may hold the first product
    '[{"item":{"@type":"Product","name":"in"}},{"@type":"Product","name":"out"}]': ("open", None),
    '{"main":{"@type":"Product"},"@graph":[{"@type":"Product"}]}': ("open", None),
    '[{"x":[{"@type":"Product"}]}]': ("open", None),
    # what another writer may change, what is no JSON, types that are no plain value
    '[{"@type":"Product","n":1e400}]': ("open", None),
    '[{"@type":"Product","n":12345678901234567890}]': ("open", None),
    '[{"\\u0040type":"Product"}]': ("open", None),
    '[{"@type":"Product"},]': ("open", None),
    '[{"@type":["Product"]},{"@type":"Product"}]': ("open", None),
    "[]": ("none", None),
    '[{"@type":"Product"}] []': ("open", None),
    "": ("none", None),
}


def test_lists_and_graphs_without_a_walk(spark):
    blocks = list(LISTS)
    states = spark.createDataFrame([(blocks,)], "b array<string>").select(jsonld.block_states(F.col("b")).alias("s")).first()["s"]
    for block, state in zip(blocks, states, strict=True):
        verdict, node = LISTS[block]
        assert state["verdict"] == verdict, block
        assert state["node"] == (block if node is None else node)
    # the walk finds the same product, whoever decides
    walk = jsonld._block_walker()
    for block, state in zip(blocks, states, strict=True):
        if state["verdict"] == "root":
            assert json.loads(walk(pd.Series([[block]]))["node"][0]) == json.loads(state["node"])


def test_anchors_nobody_asked_for_are_not_read(spark):
    """Brands alone look at brand anchors; a target may be written with references."""
    html = (
        '<a title="S" href="/ingredients/s"></a><a href="&#47;brand/x"> X </a><a href="/other">/brand</a>'
        "<a data-name='/brand \x01' href=/brand/y\x01z title=t>Y</a>"
    )
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    parts = products.page_parts(pages, B, parts=("brands",))
    assert [tuple(b) for b in parts.first()["brands"]] == [(f"{B}/brand/x", "X"), (f"{B}/brand/y\x01z", "Y")]
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    # once, to tell brand anchors from others
    assert plan.count(products.INGREDIENT_PREFIX) == 1
    every = products.page_parts(pages, B).first()
    assert [e["name"] for e in every["events"]] == ["S", "S"]
