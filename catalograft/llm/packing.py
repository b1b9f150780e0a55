"""Bounded-space online packing of tokenised documents into sequences."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalograft.session import settle

LENGTH = 2048
END = 1
#: Windows a task keeps open.
OPEN = 32
#: A window this close to full is emitted as it is; a larger gap is filled by cutting a document.
MOST_PADDING = 16
#: Partitions whose leftover windows one merging task gets.
FAN = 16
#: Distinct chunks a worker remembers.
_REMEMBERED = 400_000

_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
        ("offset", pa.int64()), ("task", pa.int64()), ("ids", pa.binary()),
    ]
)
_SQL_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, task long, ids binary"
)


class Encoder:
    """Byte-level BPE ids of whole texts as little-endian bytes.

    The ids equal those of the tokenizers library for the same file. A text is cut before
    each space that starts a token, and a chunk met before is looked up instead of encoded.
    With `special`, a special token's string in a text is that token, as in the library by default:
    such texts are encoded by the library. Without, it is ordinary text.
    """

    _known: dict[str, tuple] = {}
    _libraries: dict[str, object] = {}
    _special: dict[str, list[str]] = {}
    # fixed values: Unicode's white space
    _long_space = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
    _inside = re.compile(r" (?<=\s )(?:\s|\Z)")

    def __init__(self, path: str, special: bool = False):
        if path not in self._known:
            self._known[path] = (self._encoding(path), {})
        self.encode, self.chunks = self._known[path]
        self.special: list[str] = []
        self.path = path
        if special:
            if path not in self._special:
                with open(path, encoding="utf-8") as file:
                    self._special[path] = [t["content"] for t in json.load(file)["added_tokens"]]
            self.special = self._special[path]

    def _by_library(self, text: str) -> bytes:
        """Loaded when the first text needs it: it takes some 30 MB of a worker."""
        if self.path not in self._libraries:
            from tokenizers import Tokenizer

            self._libraries[self.path] = Tokenizer.from_file(self.path)
        return np.array(self._libraries[self.path].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def _encoding(path: str):
        import tiktoken
        from tokenizers import Tokenizer

        vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
        # the byte-level alphabet: printable bytes stand for themselves, others follow 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {}
        for token, rank in vocabulary.items():
            if all(c in byte for c in token):
                ranks[bytes(byte[c] for c in token)] = rank
        special = [t for t in ranks if t == b"<|endoftext|>"]
        for token in special:
            del ranks[token]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encoding = tiktoken.Encoding("text", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

        def encode(text: str) -> bytes:
            if len(text) < 1000:
                return np.array(encoding.encode_ordinary(text), "<u4").tobytes()
            ids: list[int] = []
            at = 0
            # the engine's pattern cannot take very long white space: a run is one piece up to its last
            # character, which belongs to what follows, and all of it at the end of the text
            for run in Encoder._long_space.finditer(text):
                end = run.end() - (run.end() < len(text))
                ids += encoding.encode_ordinary(text[at : run.start()])
                ids += encoding._encode_single_piece(text[run.start() : end])
                at = end
            ids += encoding.encode_ordinary(text[at:])
            return np.array(ids, "<u4").tobytes()

        return encode

    def __call__(self, texts: list[str]) -> list[bytes]:
        encode, chunks = self.encode, self.chunks
        out = []
        for text in texts:
            if any(token in text for token in self.special):
                out.append(self._by_library(text))
                continue
            if self._inside.search(text):  # a space within a run of white space starts no token
                out.append(encode(text))
                continue
            first, *rest = text.split(" ")
            if len(chunks) > _REMEMBERED:
                chunks.clear()
            for chunk in set(rest):
                if chunk not in chunks:
                    chunks[chunk] = encode(" " + chunk)
            out.append(encode(first) + b"".join([chunks[c] for c in rest]))
        return out


class Packer:
    """Open windows of one task. A piece: (doc_id, start, doc_tokens, ids)."""

    def __init__(self, number: int, length: int, most_padding: int, most_open: int):
        self.number, self.length = number, length
        self.most_padding, self.most_open = most_padding, most_open
        self.open: list[tuple[int, list]] = []  # (free, pieces)
        self.rows: list[tuple] = []
        self.emitted = 0

    def add(self, piece: tuple) -> None:
        doc_id, start, doc_tokens, ids = piece
        size = len(ids) // 4
        while size >= self.length:
            self.emit([(doc_id, start, doc_tokens, ids[: 4 * self.length])])
            ids, start, size = ids[4 * self.length :], start + self.length, size - self.length
        if size:
            self.place((doc_id, start, doc_tokens, ids), size)

    def place(self, piece: tuple, size: int) -> None:
        fits = [(free, i) for i, (free, _) in enumerate(self.open) if free >= size]
        if fits:
            free, i = min(fits)
            self.open[i][1].append(piece)
            self.open[i] = (free - size, self.open[i][1])
            if free == size:
                self.emit(self.open.pop(i)[1])
        elif len(self.open) < self.most_open:
            self.open.append((self.length - size, [piece]))
        else:
            free, i = min((free, i) for i, (free, _) in enumerate(self.open))
            pieces = self.open.pop(i)[1]
            if free > self.most_padding:
                doc_id, start, doc_tokens, ids = piece
                pieces.append((doc_id, start, doc_tokens, ids[: 4 * free]))
                piece = (doc_id, start + free, doc_tokens, ids[4 * free :])
                size -= free
            self.emit(pieces)
            self.place(piece, size)

    def emit(self, pieces: list[tuple], task: int | None = None) -> None:
        sequence, offset = self.number + self.emitted, 0
        self.emitted += 1
        for doc_id, start, doc_tokens, ids in pieces:
            size = len(ids) // 4
            kept = None if task is None else ids
            crc = zlib.crc32(ids)
            self.rows.append((doc_id, start, size, crc, doc_tokens, sequence, offset, task, kept))
            offset += size

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = zip(*rows, strict=True) if rows else [[] for _ in _SCHEMA]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA
        )


def _sliced(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Ids and texts in lists of about `most` characters."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(*batch.columns, strict=True):
        ids.append(doc_id.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def pack(
    docs: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    most_open: int = OPEN,
    most_padding: int = MOST_PADDING,
    special: bool = False,
) -> DataFrame:
    """Pieces of documents, each with its place in a sequence of at most `length` ids.

    In: doc_id, text (other columns are ignored). Out per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset. Each task reads its share of the documents
    once and keeps `most_open` windows: a document goes to the fullest window with room;
    if none has room, the fullest is emitted, filled by the head of the document when the
    gap exceeds `most_padding`. Windows left at a task's end are merged by rounds: each
    task of a round gets those of `FAN` tasks of the one before and keeps less than one.

    With `special`, the string of a special token is that token, else ordinary text.

    Null or empty text: only the end id. Texts over `length` ids: full sequences first. A
    repeated row is packed again. Null doc_id: stays null. No rows: no rows.
    """
    end = np.array([END], "<u4").tobytes()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder = Encoder(tokenizer, special)
        packer = Packer(task << 28, length, most_padding, most_open)
        for batch in batches:
            for ids, texts in _sliced(batch):
                for doc_id, encoded in zip(ids, encoder(texts), strict=True):
                    encoded += end
                    packer.add((doc_id, 0, len(encoded) // 4, encoded))
                yield packer.taken()
        for _, pieces in packer.open:
            packer.emit(pieces, task)
        yield packer.taken()

    rows = settle(docs.select("doc_id", "text").mapInArrow(first, _SQL_SCHEMA))
    tasks = (rows.agg(F.max("task")).first()[0] or 0) + 1
    done = [rows.where("ids is null")]
    level = 1
    while True:
        tasks = -(-tasks // FAN)
        merge = _merger(level, tasks == 1, length, most_padding, most_open)
        grouped = rows.where("ids is not null").groupBy(F.expr(f"task div {FAN}").alias("g"))
        rows = settle(grouped.applyInArrow(merge, _SQL_SCHEMA))
        done.append(rows.where("ids is null"))
        if tasks == 1:
            break
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.drop("task", "ids")


def _merger(level: int, last: bool, length: int, most_padding: int, most_open: int):
    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        packer = Packer((level << 56) | (group << 28), length, most_padding, most_open)
        windows: dict[int, list] = {}
        for row in rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            piece = (row["doc_id"], row["start"], row["doc_tokens"], row["ids"])
            windows.setdefault(row["sequence_id"], []).append(piece)
        used = {w: sum(len(p[3]) // 4 for p in pieces) for w, pieces in windows.items()}
        # whole windows first, fullest first, into the fullest with room
        merged: list[tuple[int, list]] = []
        for w in sorted(windows, key=lambda w: (-used[w], w)):
            fits = [(free, i) for i, (free, _) in enumerate(merged) if free >= used[w]]
            if fits:
                free, i = min(fits)
                merged[i] = (free - used[w], merged[i][1] + windows[w])
            else:
                merged.append((length - used[w], windows[w]))
        # what still has a large gap is cut into full windows and one rest
        rest, size = [], 0
        for free, pieces in merged:
            if free <= most_padding:
                packer.emit(pieces)
                continue
            for doc_id, start, doc_tokens, ids in pieces:
                while ids:
                    room = 4 * (length - size)
                    rest.append((doc_id, start, doc_tokens, ids[:room]))
                    size += len(ids[:room]) // 4
                    start += len(ids[:room]) // 4
                    ids = ids[room:]
                    if size == length:
                        packer.emit(rest)
                        rest, size = [], 0
        if rest:
            packer.emit(rest, None if last else group)
        return pa.Table.from_batches([packer.taken()])

    return merge
