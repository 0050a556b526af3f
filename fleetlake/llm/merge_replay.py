"""Byte-level BPE by replaying the merges of a rank file over a corpus, and decoding.

The corpus is worked off in blocks, the Arrow batches of bounded size that Spark hands to a task. The distinct words of a
block (matches of the tokenizer's pattern) that the worker has not met yet lie one behind the other in one array of
symbols. An inverted index leads from each pair of neighbouring symbols, named by the token that the pair makes, to the
places where it stands. Merges are applied in the order of their ranks, each to all its places in all words at once; only
the neighbours of a place are looked at again and put into the index. Words are independent of each other, so the result
of a word does not depend on the block it meets, and the ids of words met before are remembered. Nothing is shuffled.

That equals the library's rule, in each word the pair of lowest rank and of these the leftmost: places are taken from left
to right, a merge never makes a pair of its own rank, and if it makes one of a lower rank (a token may be made of other
parts than those it was learnt from), that rank is replayed before the other places of the higher one. Merges of low rank, which have many places, are
applied as arrays; a word in which one of them makes a pair of a lower rank is replayed once more, place by place. A word that is a
token itself is that token, as in the library.

Defined cases: a null or empty text has no ids. Rows that repeat a ``doc_id`` each get their row, a null ``doc_id`` stays.
Extra columns are left out. A long text is split in stretches; only a single word is held whole, however long.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlake.llm.common import bounded_batches, keyed_texts
from fleetlake.llm.pretokens import split

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Bytes of remembered words and ids in a worker; beyond it, it starts anew.
REMEMBERED_BYTES = 96 << 20
#: Longer words are not remembered.
REMEMBERED_CHARS = 64
#: What a remembered word takes beside its characters and ids.
_WORD_OVERHEAD = 160
#: Bytes of new words that are replayed together.
REPLAY_BYTES = 4 << 20
#: Merges of lower rank have many places in a block, which are merged as arrays; later ones go place by place.
ARRAY_RANKS = 12000
_SHIFT = 20
_NONE = -1


class Merges:
    """A rank file: the bytes of each id, and the id that each pair of ids merges to (its rank)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.id_of = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(self.id_of.values()) + 1)
        for token, i in self.id_of.items():
            self.bytes_of[i] = token
        self._byte = np.array([self.id_of[bytes([b])] for b in range(256)])
        self._made: dict[int, int] = {}
        for token, i in self.id_of.items():
            for cut in range(1, len(token)):
                a, b = self.id_of.get(token[:cut]), self.id_of.get(token[cut:])
                if a is not None and b is not None:
                    self._made[a << _SHIFT | b] = i
        self._pairs = np.array(sorted(self._made), dtype=np.int64)
        self._ranks = np.array([self._made[k] for k in self._pairs.tolist()], dtype=np.int64)

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ids that pairs of symbols make, ``_NONE`` where they make none."""
        if not len(self._pairs):
            return np.full(len(a), _NONE)
        keys = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self._pairs, keys), len(self._pairs) - 1)
        return np.where((self._pairs[at] == keys) & (a != _NONE) & (b != _NONE), self._ranks[at], _NONE)

    def replay(self, words: list[bytes], array_ranks: int = ARRAY_RANKS) -> list[bytes]:
        """The ids of each word (not empty) as little-endian 32-bit integers, all merges replayed over all words together."""
        data = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        symbols = self._byte[data]
        symbols[ends] = _NONE
        symbols = np.append(symbols, _NONE)
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        irregular = self._merge_arrays(symbols, after, before, array_ranks)
        symbols = np.array(self._merge_places(symbols, after, before))
        places = np.flatnonzero(symbols != _NONE)
        bounds = [0, *(4 * np.searchsorted(places, ends)).tolist()]
        ids = symbols[places].astype("<i4").tobytes()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        again = sorted(set(np.searchsorted(ends, irregular).tolist()))
        for i, found in zip(again, self.replay([words[i] for i in again], 0) if again else ()):
            out[i] = found
        return out

    def _index(self, symbols: np.ndarray, after: np.ndarray, places: np.ndarray) -> dict[int, list[np.ndarray]]:
        """The given places by the token that the pair there makes."""
        made = self._look_up(symbols[places], symbols[after[places]])
        return _by_rank(made, places)

    def _merge_arrays(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray, most: int) -> np.ndarray:
        """Apply all merges of ranks below ``most``, each to all its places at once. Returns places of words in which a
        merge made a pair of a lower rank: their order was not kept, they are to be replayed place by place."""
        irregular = [np.zeros(0, dtype=np.int64)]
        if most <= 0:
            return irregular[0]
        index = self._index(symbols, after, np.flatnonzero(symbols[:-1] != _NONE))
        queue = [r for r in index if r < most]
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = np.unique(np.concatenate(index.pop(rank)))
            # Places are not taken out of the index when a neighbour merges: what stands there now counts.
            places = places[self._look_up(symbols[places], symbols[after[places]]) == rank]
            if len(places) > 1:
                # In a row of overlapping places every other one merges, from the left.
                at = np.arange(len(places))
                alone = np.append(True, after[places[:-1]] != places[1:])
                places = places[(at - np.maximum.accumulate(np.where(alone, at, 0))) % 2 == 0]
            if not len(places):
                continue
            gone = after[places]
            right = after[gone]
            was_right = symbols[right]
            symbols[places], symbols[gone] = rank, _NONE
            after[places], before[right] = right, places
            left = before[places]
            ranks = np.full(len(places), rank)
            made_left, made_right = self._look_up(symbols[left], ranks), self._look_up(ranks, symbols[right])
            first_right = self._look_up(ranks, was_right)
            lower = ((made_left != _NONE) & (made_left < rank)) | ((first_right != _NONE) & (first_right < rank))
            if lower.any():
                irregular.append(places[lower])
            for new, found in _by_rank(np.append(made_left, made_right), np.append(left, places), rank, most).items():
                if new in index:
                    index[new].extend(found)
                else:
                    index[new] = found
                    heapq.heappush(queue, new)
        return np.concatenate(irregular)

    def _merge_places(self, symbols: np.ndarray, after: np.ndarray, before: np.ndarray) -> list[int]:
        """Apply the merges that are left, place by place; returns the symbols."""
        found = self._index(symbols, after, np.flatnonzero(symbols[:-1] != _NONE))
        index = {r: places[0].tolist() for r, places in found.items()}
        symbols, after, before, made = symbols.tolist(), after.tolist(), before.tolist(), self._made.get
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            places = index.pop(rank)
            places.sort()
            for n, i in enumerate(places):
                j = after[i]
                if made(symbols[i] << _SHIFT | symbols[j]) != rank or symbols[i] == _NONE or symbols[j] == _NONE:
                    continue
                symbols[i], symbols[j] = rank, _NONE
                k, h = after[j], before[i]
                after[i], before[k] = k, i
                lower = False
                for place, a, b in ((h, symbols[h], rank), (i, rank, symbols[k])):
                    new = made(a << _SHIFT | b) if a != _NONE and b != _NONE else None
                    if new is not None:
                        lower = lower or new < rank
                        if new in index:
                            index[new].append(place)
                        else:
                            index[new] = [place]
                            heapq.heappush(queue, new)
                if lower:  # that rank comes first, then the places that are left of this one
                    index[rank] = places[n + 1:]
                    heapq.heappush(queue, rank)
                    break
        return symbols


def _by_rank(made: np.ndarray, places: np.ndarray, above: int = _NONE, below: int = 1 << _SHIFT) -> dict[int, list[np.ndarray]]:
    """``places`` by what they make, for ranks between the bounds."""
    of_use = np.flatnonzero((made > above) & (made < below))
    order = of_use[np.argsort(made[of_use], kind="stable")]
    ranks = made[order]
    starts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1])) if len(ranks) else ranks
    bounds, places = [*starts.tolist(), len(ranks)], places[order]
    return {r: [places[a:b]] for r, a, b in zip(ranks[starts].tolist(), bounds, bounds[1:])}


class Replayer:
    """Ids of blocks of texts, with the ids of words met before."""

    def __init__(self, path: str, remembered_bytes: int = REMEMBERED_BYTES) -> None:
        self.merges = Merges(path)
        self._known: dict[str, bytes] = {}
        self._size = 0
        self._most = remembered_bytes

    def _learn(self, words: list[str]) -> None:
        held: list[str] = []
        size = 0
        for n, word in enumerate(words, 1):
            data = word.encode()
            whole = self.merges.id_of.get(data)
            if whole is not None:
                self._known[word] = whole.to_bytes(4, "little")
                self._size += len(word) + 4 + _WORD_OVERHEAD
            else:
                held.append(word)
                size += len(data) + 1
            if held and (size >= REPLAY_BYTES or n == len(words)):
                for w, ids in zip(held, self.merges.replay([w.encode() for w in held])):
                    self._known[w] = ids
                    self._size += len(w) + len(ids) + _WORD_OVERHEAD
                held, size = [], 0

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        if self._size > self._most:
            self._known.clear()
            self._size = 0
        known = self._known
        split_texts = [split(t) for t in texts]
        new = set().union(*split_texts).difference(known)
        self._learn(list(new))
        out = [b"".join(map(known.__getitem__, words)) for words in split_texts]
        for word in new:
            if len(word) > REMEMBERED_CHARS:
                self._size -= len(word) + len(known.pop(word)) + _WORD_OVERHEAD
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.bytes_of.__getitem__, ids))


_replayers: dict[str, Replayer] = {}


def replayer(path: str) -> Replayer:
    """This process's replayer for a rank file."""
    if path not in _replayers:
        _replayers[path] = Replayer(path)
    return _replayers[path]


def encode(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, ids)``: the ids of every text."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = replayer(ranks).encode(batch.column(1).to_pylist())
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "ids"])

    return keyed_texts(docs).mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, ids, data)``: the bytes that the ids of every row stand for. Null ids have no bytes; an id that the file
    lacks is an error."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            ids, sizes = column.flatten().to_numpy().tolist(), (0 if n is None else n for n in column.value_lengths().to_pylist())
            bounds = [0, *itertools.accumulate(sizes)]
            data = [replayer(ranks).decode(ids[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], names=["doc_id", "ids", "data"])

    bounded_batches(encoded)
    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, ids array<int>, data binary")
