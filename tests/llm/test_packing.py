import zlib

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from catalograft.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True

ODD = [
    "a  b", " a", "a ", "  ", "a \n b", "a\n b", "a\n  b", "a \nb\n", "x  y  z", "　 a", "it's we'll 12.5 'S", "<|endoftext|> a",
    "a\x1c \x1db", "\t\ta  \t b", "é ß \U0001f600 \U0001f600", "a\n ", "one\r\n two", "x" * 3_000, " " * 100, "'re 're'", "a\x85 b ​ c",
]


def ids_of(text):
    return np.array(TOKENIZER.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_ids_equal_those_of_the_library(documents):
    texts = [*ODD, *(r["text"] for r in documents.collect())]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(PATH)(texts)] == [ids_of(t).tolist() for t in texts]


def test_special_strings_as_the_unchanged_library(make):
    library = Tokenizer.from_file(PATH)
    texts = [*ODD, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a<|endoftext|>b  c\n", "<|endoftext| >"]
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in packing.Encoder(PATH, special=True)(texts)] == wanted
    assert wanted[len(ODD)] == [64, 220, 50256, 275]
    pieces = packing.pack(make(*enumerate(texts)), PATH, special=True).collect()
    for p in pieces:
        ids = np.array([*wanted[p["doc_id"]], 1], "<u4")
        assert p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())


def check(pieces, docs, length, most_pad=None):
    whole = {}
    for doc_id, text in docs:
        whole.setdefault(doc_id, []).append(np.concatenate([ids_of(text), np.array([1], "<u4")]))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(whole)
    for doc_id, mine in by_doc.items():
        # every id of every copy lies in exactly one piece
        wanted = sorted((len(w), i) for w in whole[doc_id] for i in range(len(w)))
        assert sorted((p["doc_tokens"], i) for p in mine for i in range(p["start"], p["start"] + p["length"])) == wanted
        for p in mine:
            parts = [w[p["start"] : p["start"] + p["length"]] for w in whole[doc_id] if len(w) == p["doc_tokens"]]
            assert p["ids_crc32"] in {zlib.crc32(w.tobytes()) for w in parts}
    sizes = []
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= length
        sizes.append(at)
    if most_pad is not None:
        assert sum(length - s for s in sizes) <= most_pad * len(sizes) * length + length


@pytest.mark.parametrize("length, parts", [(2_048, 1), (64, 40)])
def test_every_id_is_packed_once(hard_rows, make, documents, length, parts):
    rows = [*hard_rows, *enumerate(ODD, 100), *((r["doc_id"] + 1_000, r["text"]) for r in documents.limit(60).collect())]
    pieces = packing.pack(make(*rows).repartition(parts), PATH, length=length, most_open=8, most_padding=2).collect()
    check(pieces, rows, length, 0.05)


def test_little_padding(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check(packing.pack(documents.repartition(20), PATH).collect(), rows, packing.LENGTH, 0.02)


def test_best_fit_and_the_fullest_leaves():
    packer = packing.Packer(0, 10, 0, 2)

    def add(doc, n):
        packer.add((doc, 0, n, b"\0" * 4 * n))

    add(1, 6), add(2, 3), add(3, 3)  # 3 goes to the fuller window
    assert [free for free, _ in packer.open] == [1, 7]
    add(4, 8)  # fits nowhere: the fullest takes its head and leaves
    sequences = {r[5] for r in packer.rows}
    assert len(sequences) == 2 and {r[0] for r in packer.rows} == {1, 2, 3, 4}


def test_empty_table(make):
    assert packing.pack(make().where("doc_id = 0"), PATH).count() == 0


def test_the_library_is_loaded_when_a_text_needs_it(monkeypatch):
    monkeypatch.setattr(packing.Encoder, "_libraries", {})
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), special=True)
    encoder(["plain text", " \n" * 3000])
    assert not encoder._libraries
    encoder([encoder.special[0]])
    assert encoder._libraries


def test_long_white_space_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoder = packing.Encoder(path, special=True)
    for space in ("\n", " ", "\t", "　", " \n", "\xa0 "):
        for shape in ("{}", "a{}", "{}b", "a{}b.", "a {}'s{}!", "x{} y"):
            text = shape.format(*[space * 1500] * shape.count("{}"))
            got = np.frombuffer(encoder([text])[0], "<u4").tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, (space, shape)
    long = "a" + "\n" * 5_000_000 + "b"
    assert len(encoder([long])[0]) > 0
