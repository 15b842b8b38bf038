"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words; decoding joins binary pieces.

Words are the matches of the tokenizer's pattern. The distinct words of a run of texts become rows of a
matrix of ids, one byte an id; each round looks all neighbouring pairs up in the rank map, merges the least
rank of every row, leftmost first, and drops rows without a pair. The ids of a text are those of its words.
The rank file is read on the driver, from any path, and broadcast: its size does not depend on the input.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

_NONE = np.int64(2**62)
#: Words up to LONG bytes are folded as a matrix, longer ones with a heap. A worker remembers words for some MEMO
#: bytes at once, and takes texts of some CHUNK characters at once; neither changes a result.
LONG, MEMO, CHUNK = 48, 64 << 20, 1 << 19
#: Bytes that a remembered word takes beside its letters and ids.
_ENTRY = 160


class Codec:
    """Encodes and decodes by the ranks of ``rank_file`` (lines of base64 token and rank) and ``pattern``."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line.strip())}
        self.pieces = {r: t for t, r in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        pairs = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.ids = np.empty(0, np.uint32)
        self.start = np.zeros(1, np.int64)

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        key = ids[:, :-1] << 32 | ids[:, 1:]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (ids[:, 1:] >= 0), self.values[at], _NONE)

    def _fold(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words of up to ``LONG`` bytes."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(words)
        size = np.array([len(w) for w in words])
        rows = np.argsort(size, kind="stable")
        for part in np.array_split(rows, max(1, len(rows) // 20_000)):
            width = int(size[part].max(initial=0))
            raw = np.frombuffer(b"".join(words[r].ljust(width, b"\0") for r in part), np.uint8).reshape(len(part), width)
            ids = np.where(np.arange(width) < size[part][:, None], self.bytes[raw], -1)
            live, where = ids, part
            while len(where):
                rank = self._merged(live) if live.shape[1] > 1 else np.full((len(where), 1), _NONE)
                best = rank.argmin(1)
                least = rank[np.arange(len(where)), best]
                done = least == _NONE
                for r, row in zip(where[done], live[done], strict=True):
                    out[r] = row[row >= 0].astype(np.uint32)
                live, where, best, least = live[~done], where[~done], best[~done], least[~done]
                if len(where):
                    live[np.arange(len(where)), best] = least
                    keep = np.ones(live.shape, bool)
                    keep[np.arange(len(where)), best + 1] = False
                    live = live[keep].reshape(len(where), -1)
        return out

    def _fold_long(self, word: bytes) -> np.ndarray:
        table = dict(zip(self.keys.tolist(), self.values.tolist(), strict=True)) if not hasattr(self, "_table") else self._table
        self._table = table
        ids, n = self.bytes[np.frombuffer(word, np.uint8)].tolist(), len(word)
        after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []
        for i in range(n - 1):
            if (r := table.get(ids[i] << 32 | ids[i + 1])) is not None:
                heap.append((r, i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (s := table.get(ids[x] << 32 | ids[after[x]])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[after[x]]))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def _learn(self, words: list[str]) -> None:
        data = [w.encode() for w in words]
        found: list[np.ndarray | None] = [np.array([self.ranks[d]], np.uint32) if d in self.ranks else None for d in data]
        short = [i for i, (d, f) in enumerate(zip(data, found, strict=True)) if f is None and len(d) <= LONG]
        for i, ids in zip(short, self._fold([data[i] for i in short]), strict=True):
            found[i] = ids
        found = [self._fold_long(d) if f is None else f for d, f in zip(data, found, strict=True)]
        self.number |= {w: len(self.number) + k for k, w in enumerate(words)}
        self.ids = np.concatenate([self.ids, *found])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum([len(f) for f in found], dtype=np.int64)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.find(t) for t in texts]
        new = set().union(*split)
        if self.held > MEMO:
            self.forget()
        if new := new - self.number.keys():
            self._learn(sorted(new))
            self.held += sum(_ENTRY + 6 * len(w) for w in new)
        out = []
        for words in split:
            w = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
            a = self.start[w]
            n = self.start[w + 1] - a
            out.append(self.ids[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


_codecs: dict[str, Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec for each file and pattern in a process."""
    key = hashlib.sha256(rank_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(rank_file, pattern)
    return _codecs[key]


def forget_words() -> None:
    """Drop remembered words; the rank maps, whose size is fixed, stay for the next task."""
    for c in _codecs.values():
        c.forget()


def _chunks(column: pa.Array):
    texts, size, rows = [], 0, 0
    for t in column:
        t = t.as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= CHUNK:
            yield rows, texts
            rows, texts, size = rows + len(texts), [], 0
    if texts:
        yield rows, texts


def _coded(shared, pattern: str, digest: bool, ids: bool):
    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            for at, texts in _chunks(batch.column(1)):
                coded = c.encode(texts)
                out, names = [batch.column(0)[at : at + len(texts)]], ["doc_id"]
                if ids:
                    ends = pa.array(np.cumsum([0, *map(len, coded)], dtype=np.int32))
                    out.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(coded).astype(np.int32))))
                    names.append("ids")
                if digest:
                    out += [pa.array([len(x) for x in coded], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in coded])]
                    names += ["n_tokens", "ids_sha256", "decoded_sha256"]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def encode(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids`` of every row; a null text is empty and has no ids. Keys may repeat or be null."""
    shared = docs.sparkSession.sparkContext.broadcast(_read(rank_path))
    return _columns(docs, key, text).mapInArrow(tidy(_coded(shared, pattern, False, True)), "doc_id long, ids array<int>")


def decode(coded: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, data``: the bytes that the ids stand for, which are UTF-8 where the ids end at a character."""
    shared = coded.sparkSession.sparkContext.broadcast(_read(rank_path))

    def run(batches):
        c = codec(shared.value, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return coded.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(tidy(run), "doc_id long, data binary")


def round_trip(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, with ``ids`` the ids too: encode, then decode the ids.

    Null and empty texts have no tokens. Rows are independent: repeated rows give repeated results, an empty
    table gives an empty one, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_read(rank_path))
    return _columns(docs, key, text).mapInArrow(tidy(_coded(shared, pattern, True, ids)), f"doc_id long, {'ids array<int>, ' * ids}n_tokens long, ids_sha256 string, decoded_sha256 string")
