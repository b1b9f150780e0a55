from types import SimpleNamespace

import corpus_pipeline
from catalograft.llm.queries import ORACLES, QUERIES


def test_stages_in_order_on_hard_rows(spark, make, documents, tmp_path):
    text = " ".join(f"word{i}" for i in range(300))
    extra = make((1_001, text), (1_002, text.replace("word20 ", "other ")), (1_003, f"{text} password=hunter22 or so"), (1_004, None), (1_005, "12 34"), (1_001, text))
    docs = documents.unionByName(extra.select(documents.columns))
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{number}")
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    assert list(kept) == ["language_id", "near_duplicates", "secrets", "mixing", "packing"]
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    assert not ids["language_id"] & {1_004, 1_005} and {1_001, 1_002, 1_003} <= ids["language_id"]
    assert 1_001 in ids["near_duplicates"] and len(kept["near_duplicates"]) == len(ids["near_duplicates"])
    assert ids["secrets"] == ids["near_duplicates"]
    assert not any("hunter22" in r["text"] for r in kept["secrets"])
    assert ids["packing"] == ids["mixing"] <= ids["secrets"]


def test_texts_of_an_unlearned_script_go(spark, make, documents):
    foreign = [
        "Мы живем в большом городе и каждый день ходим на работу. " * 4, "我们住在一个大城市里,每天去上班,因为人们都是这样做的。" * 6,
        "Ζούμε σε μια μεγάλη πόλη και κάθε μέρα πηγαίνουμε στη δουλειά. " * 4, "نحن نعيش في مدينة كبيرة ونذهب إلى العمل كل يوم. " * 4,
    ]
    docs = documents.unionByName(make(*enumerate(foreign, 5_000)).select(documents.columns))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in documents.collect()}


def test_texts_no_better_than_chance_go(spark, make, monkeypatch):
    monkeypatch.setattr(corpus_pipeline.langid, "identify", lambda docs, net: docs.selectExpr("*", "'en' lang_pred", "cast(size as double) lang_score"))
    monkeypatch.setattr(corpus_pipeline.langid, "fit", lambda docs: SimpleNamespace(languages=["de", "en", "es", "fr"], letters="ab"))
    docs = make((1, "a", None, None, 1, "0.26"), (2, "a", None, None, 1, "0.9"))
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()] == [2]


def test_run_writes_all_stages(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_extra_columns_of_any_name_and_type(spark, make, tmp_path):
    """Every stage carries columns named like its own, also maps, and answers as without them."""
    names = [
        "lang_pred", "LANG_SCORE", "__k", "__n", "__i", "__t", "__c", "__w", "__taken", "__size", "__key", "__scanned", "__base", "__weak", "__linked",
        "secret_base", "secret_linked", "size", "taken", "text_key", "component", "fp", "task", "ids", "start", "_kept_0", "a.b", "Bucket",
    ]
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = make((9_001, "the user jane has password=hunter22 and so on"), (9_001, "the user jane has password=hunter22 and so on"), (9_002, None))
    plain = base.unionByName(extra.select(base.columns))
    crowded = plain.selectExpr("*", *(f"concat('x', doc_id) as `{n}`" for n in names), "map('k', text) as m", "array(map(1, source)) as n")
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = crowded.columns
        for at, docs in (("p", plain), ("c", crowded)):
            stage(spark, docs, "").write.parquet(f"{tmp_path}/{at}{number}")
        before, crowded = crowded, spark.read.parquet(f"{tmp_path}/c{number}")
        plain = spark.read.parquet(f"{tmp_path}/p{number}")
        if name != "packing":
            assert crowded.columns == columns
            assert crowded.where("`lang_pred` <> concat('x', doc_id) or `a.b` <> concat('x', doc_id)").isEmpty()
            assert sorted(map(str, crowded.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
        else:
            lengths = [df.selectExpr("sum(length)", "count(distinct doc_id)").first() for df in (plain, crowded)]
            assert lengths[0] == lengths[1]
