import re
from collections import Counter

import numpy as np
import pytest

from catalograft.llm import collocations as c

ENDS = re.compile(r"[.,;:!?\n\v\f\r]")


def pieces_of(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in ENDS.split(low)]


def by_hand(rows, least, top=2000, absorbed=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for words in pieces_of(text):
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for lang in {k for k, _ in f}:
        mine = {p: v for (la, p), v in f.items() if la == lang}
        kept = []
        for p, a in mine.items():
            if len(p) < 2:
                continue
            around = [q for q in mine if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * mine[q] >= absorbed * a for q in around):
                continue
            score, k = min((1000 * a * n[lang] // (mine[p[:k]] * mine[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), " ".join(p), a, mine[p[:k]], mine[p[k:]], n[lang], score))
        out += [(lang, rank, *r[3:]) for rank, r in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def frame(spark, rows, parts=3):
    full = [(i, la, t, "x", "y") for i, (la, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, lang string, text string, shard string, n string").repartition(parts)


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_counting_by_hand(spark, parts):
    rng = np.random.default_rng(parts)
    words = np.array(["the", "cat", "sat", "ON", "mat", "été", "\x1cx", "a"])
    rows = [
        (["en", "fr", None][i % 3], " ".join(rng.choice(words, 40, p=[0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])) + ["", ". the cat\tsat", "!"][i % 3])
        for i in range(60)
    ]
    rows += [("en", None), ("en", ""), ("en", " \t\n.,"), ("en", "the cat sat on"), ("en", "the cat sat on"), ("und", "the cat, the cat")]
    rows += [("en", "all rights reserved here now and then.\n" * 7), ("de", "x" * 5000 + " the"), ("en", "long tail " * 20_000)]
    got = sorted(tuple(r) for r in c.collocations(frame(spark, rows, parts), least=7).collect())
    assert got == by_hand(rows, 7) and {r[0] for r in got} >= {"en", "fr", "und"}


def test_extensions_of_a_phrase(spark):
    rows = [("en", "new york city"), ("en", "new york state"), ("en", "old new york"), ("en", "new york city")]
    found = {r["phrase"]: r for r in c.frequent_phrases(frame(spark, rows, 2), least=2).collect()}
    assert (found["new york"]["f"], found["new york"]["left"], found["new york"]["right"]) == (4, None, 2)
    assert found["new york city"]["firsts"] == [4, 4] and found["new york city"]["rests"] == [2, 2]


@pytest.mark.parametrize("top, absorbed", [(2, 100), (2000, 60)])
def test_top_and_absorbed(spark, top, absorbed):
    rows = [("en", "a b c d")] * 5 + [("en", "a b"), ("en", "b c"), ("en", "c d e"), ("en", "c d e")]
    got = sorted(tuple(r) for r in c.collocations(frame(spark, rows), least=2, top=top, absorbed=absorbed).collect())
    assert got == by_hand(rows, 2, top, absorbed)


def test_no_rows_and_no_words(spark):
    assert c.collocations(frame(spark, [("en", "one two")]).limit(0), least=1).count() == 0
    assert c.collocations(frame(spark, [("en", None), ("en", " .,")]), least=1).count() == 0


def test_nothing_is_left_in_the_catalog(spark):
    c.collocations(frame(spark, [("en", "one two")]), least=1).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("collocations")]


def test_bounded_order_and_both_directions():
    rng = np.random.default_rng(3)
    text = np.concatenate([[0], rng.integers(0, 5, 3000), [0]]).astype(np.int32)

    def head(i, t):
        out = []
        for x in t[i : i + c.LONGEST]:
            out.append(int(x))
            if x == 0:
                break
        return out

    order = c.bounded_order(text, c.LONGEST)
    heads = [head(i, text) for i in order]
    assert heads == sorted(heads)
    counts = Counter()
    for size in range(1, c.LONGEST + 1):
        for i in range(len(text) - size + 1):
            if (text[i : i + size] > 0).all():
                counts[tuple(int(x) for x in text[i : i + size])] += 1
    before, after = (c.Transform(c.transform(t, c.LONGEST)) for t in (text, text[::-1]))
    reverse = c.bounded_order(text[::-1], c.LONGEST)
    known = c.Phrases.words(np.arange(4), after.bwt)
    names = {i: (i + 1,) for i in range(4)}
    for level in range(2, c.LONGEST + 1):
        found = [c.grown(before, after, known, right) for right in (True, False)]
        assert sorted(zip(*(v.tolist() for v in found[0]))) == sorted(zip(*(v.tolist() for v in found[1])))
        prefix, suffix, n = found[level % 2]
        names = {i: (*names[p], names[s][-1]) for i, (p, s) in enumerate(zip(prefix.tolist(), suffix.tolist()))}
        assert {names[i]: m for i, m in enumerate(n.tolist())} == {k: v for k, v in counts.items() if len(k) == level}
        known = known.joined(before, after, prefix, suffix, np.arange(n.size))
        assert known.size.tolist() == n.tolist()
        # both intervals belong to the same phrase
        for i, name in names.items():
            assert tuple(text[order[known.text[i]] :][:level]) == name
            assert tuple(text[::-1][reverse[known.reverse[i]] :][:level][::-1]) == name
