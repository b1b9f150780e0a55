import random

import regex
import pytest

from catalograft.llm import licenses


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = regex.findall(licenses.NOTICE_WORD, low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def wanted(rows, templates):
    out = []
    for doc_id, text in rows:
        have = shingles(text)
        for name, template in templates:
            need = shingles(template)
            if need and len(need & have) >= 0.8 * len(need):
                out.append((doc_id, name, round(len(need & have) / len(need), 9)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r[0], r[1], round(r[2], 9)) for r in df.collect()), key=str)


def test_equals_exact_containment(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(licenses.scan_licenses(documents)) == wanted(rows, licenses.TEMPLATES.items())


def test_embedded_edited_and_hard_texts(make, hard_rows):
    header = licenses.TEMPLATES["apache-2.0-header"]
    words = header.split()
    edited = " ".join(w if i != 30 else "changed" for i, w in enumerate(words))
    half = " ".join(words[: len(words) // 2])
    rows = [*hard_rows, (20, f"before {header} after"), (21, edited.upper()), (22, half), (23, "Is released   under\nthe MIT license too"), (23, "Is released   under\nthe MIT license too")]
    got = found(licenses.scan_licenses(make(*rows)))
    assert got == wanted(rows, licenses.TEMPLATES.items())
    assert (21, "apache-2.0-header") in {g[:2] for g in got} and 22 not in {g[0] for g in got if g[1] == "apache-2.0-header"}
    assert sum(g[0] == 23 for g in got) == 2


def test_template_tables_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_ENTRIES", 20)
    templates = spark.createDataFrame(
        [*licenses.TEMPLATES.items(), ("short", "two words"), ("none", None), ("mit", "Some other text of this name here")],
        "license_id string, text string",
    )
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert found(licenses.scan_licenses(documents, templates)) == wanted(rows, [tuple(r) for r in templates.collect()])


def test_no_rows_no_templates(spark, make):
    none = spark.createDataFrame([], "license_id string, text string")
    assert licenses.scan_licenses(make((1, "a b c d e f")), none).count() == 0
    assert licenses.scan_licenses(make().where("doc_id = 0")).count() == 0


@pytest.mark.parametrize("shingles, bands", [(4, 1), (2, 7), (1, 17)])
def test_bands_keep_the_promise(shingles, bands):
    assert licenses.bands_for(shingles) == bands


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_recall_of_short_templates_anywhere(spark, make, n):
    rng = random.Random(n)

    def words(k):
        return " ".join(f"w{rng.getrandbits(40)}" for _ in range(k))

    notices = [words(n + 4) for _ in range(600)]
    templates = spark.createDataFrame([(str(i), t) for i, t in enumerate(notices)], "license_id string, text string")
    # both parities, and at the start and the end of a text
    places = [(0, 9), (9, 0), (8, 9), (9, 9), (0, 0), (1, 1)]
    docs = make(*((i, f"{words(before)} {t} {words(after)}") for i, t in enumerate(notices) for before, after in [places[i % 6]]))
    got = {r["doc_id"] for r in licenses.scan_licenses(docs, templates).collect() if r["license_id"] == str(r["doc_id"])}
    for k in range(6):
        assert sum(i % 6 == k for i in got) >= 97, places[k]


def test_plan_has_no_python(make):
    plan = licenses.scan_licenses(make((1, "a b c d e f")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_templates_of_any_length_with_edits(spark, make):
    """Copies with every 40th shingle changed, at both ends and between other words; near misses."""
    rng = random.Random(5)

    def words(k):
        return [f"w{rng.getrandbits(40)}" for _ in range(k)]

    templates, rows = [], []
    for size in (20, 40, 90, 200, 450, 1000, 2500):
        for k in range(12):
            template = words(size)
            edited = [w if i % 40 != 20 else "edit" for i, w in enumerate(template)] if k % 2 else template
            templates.append((f"{size}-{k}", " ".join(template)))
            around = [(0, 60), (60, 0), (33, 7)][k % 3]
            rows.append((len(rows), " ".join(words(around[0]) + edited + words(around[1]))))
            rows.append((len(rows), " ".join(template[: size // 2] + words(size // 2))))
    got = found(licenses.scan_licenses(make(*rows), spark.createDataFrame(templates, "license_id string, text string")))
    exact = wanted(rows, templates)
    assert len(exact) == 84 and set(got) <= set(exact) and len(got) >= 83


def test_one_very_long_template(spark, make, monkeypatch):
    rng = random.Random(6)
    template = " ".join(f"w{rng.getrandbits(40)}" for _ in range(50_000))
    templates = spark.createDataFrame([("long", template), ("mit", licenses.TEMPLATES["mit"])], "license_id string, text string")
    docs = make((1, f"some words before {template}"), (2, template[: len(template) // 2]), (3, f"It is {licenses.TEMPLATES['mit']}"), (4, None))
    assert found(licenses.scan_licenses(docs, templates)) == [(1, "long", 1.0), (3, "mit", 1.0)]
    # too long to broadcast
    monkeypatch.setattr(licenses, "MOST_ENTRIES", 10_000)
    assert found(licenses.scan_licenses(docs, templates)) == [(1, "long", 1.0), (3, "mit", 1.0)]
