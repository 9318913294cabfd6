"""Byte-level BPE encoding and decoding over Arrow batches (operator 3).

The rank file becomes a model of the tokenizers library: every byte has its character, every token its
mapped string, and every split of a token into two tokens is a merge of the token's rank. Texts are cut
by the pattern; each distinct piece is encoded once per batch of misses and kept in a memo of bounded size.
Where two splits of one token could compete (two of it overlap in a piece), the library may merge them in
another order than ranks and position say; such pieces are merged by rank instead. Decoding reverses the byte table; characters split over tokens meet again in the bytes.

Defined results: null text counts as empty: no ids, empty bytes. Unknown ids in decode raise. Invalid
UTF-8 in decoded bytes is kept in `bytes` and shown with replacement characters in `text`.
Rows with a null doc_id are encoded like others. Extra columns are ignored by encode, decode and digests; encode_rows carries them along.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import prepare

#: Entries of a task's memo before it starts anew (about 200 bytes each), characters of the longest one kept, and new pieces that one call of the library encodes.
MEMO, LONG, JOINED = 400_000, 64, 8192
RANKS = "byte_bpe_multi_50k.tiktoken"
#: A blank inside or at the end of a run of white space.
BLANK_INSIDE = re.compile(r" (?<=\s )(?:\s|\Z)")


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec:
    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import ahocorasick
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = byte_characters()
        self.table = dict(enumerate(table))
        shown = {t: "".join(table[b] for b in t) for t in ranks}
        merges = [(shown[t[:i]], shown[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.library = Tokenizer(models.BPE(vocab={shown[t]: i for t, i in ranks.items()}, merges=merges, cache_capacity=0))
        self.library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no byte's character is white space, so blanks part pieces
        self.ranks = ranks
        ways = {t for t in ranks if sum(t[:i] in ranks and t[i:] in ranks for i in range(1, len(t))) > 1}
        self.unsure = ahocorasick.Automaton()
        for t in ways:
            for i in range(1, len(t)):
                if t[:i] == t[-i:]:  # two of t that share their ends
                    self.unsure.add_word((t + t[i:]).decode("latin-1"), True)
        if len(self.unsure):
            self.unsure.make_automaton()
        self.split = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.known = np.array([bool(t) for t in self.tokens])
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.names = [str(i) for i in range(len(self.tokens))]
        self.known_ids: dict[str, bytes] = {}
        self.long: list[str] = []

    def forget(self) -> None:
        """Empties the memo; for the end of a task, as workers live on with other stages."""
        self.known_ids.clear()

    def _learn(self, missing: set[str]) -> None:
        """Encodes new chunks by their pieces. A piece has the ids that it has as a chunk, so one memo serves both."""
        known, ranks = self.known_ids, self.ranks
        overlaps = self.unsure.iter if len(self.unsure) else lambda s: iter(())
        cut = {c: self.split(c) for c in missing}
        rest, raws = [], []
        for p in {p for ps in cut.values() for p in ps if p not in known}:
            raw = p.encode("utf-8", "surrogatepass")
            if (one := ranks.get(raw)) is not None:
                known[p] = one.to_bytes(4, "little")
            elif next(overlaps(raw.decode("latin-1")), None):
                known[p] = np.array(self.by_rank(raw), "<u4").tobytes()
            else:
                rest.append(p)
                raws.append(raw)
        for k in range(0, len(rest), JOINED):
            known.update(zip(rest[k : k + JOINED], self._encoded(raws[k : k + JOINED]), strict=True))
        for c, ps in cut.items():
            if len(ps) != 1 or ps[0] != c:
                known[c] = b"".join(map(known.__getitem__, ps))
        self.long = [p for ps in cut.values() for p in ps if len(p) > LONG] + [c for c in missing if len(c) > LONG]

    def _encoded(self, raws: list[bytes]) -> list[bytes]:
        """Ids of each piece by the library, in one call; a piece ends where its bytes do."""
        shown = b"".join(raws).decode("latin-1").translate(self.table)
        ends = np.cumsum([len(r) for r in raws]).tolist()
        text = " ".join([shown[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)])
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
        data = ids.tobytes()
        return [data[a:z] for a, z in zip([0, *at[:-1]], at, strict=True)]

    def by_rank(self, raw: bytes) -> list[int]:
        """Merges the neighbours whose token has the least rank, the leftmost first, until no two make a token."""
        ranks, n = self.ranks, len(raw)
        after, before, end = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        gone = [False] * n
        queue = [(ranks[raw[i : i + 2]], i, i + 2) for i in range(n - 1) if raw[i : i + 2] in ranks]
        heapify(queue)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := ranks.get(raw[i : end[after[i]]])) is not None:
                heappush(queue, (rank, i, end[after[i]]))

        while queue:
            _, i, stop = heappop(queue)
            if gone[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            gone[j], end[i], after[i] = True, stop, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [ranks[raw[i : end[i]]] for i in range(n) if not gone[i]]

    def chunked(self, text: str) -> list[str]:
        """Cuts before single blanks: no piece spans such a place, so chunks are encoded on their own.

        Texts with runs of blanks, or with a blank between other white space or between that and the end (which may be
        one piece with what stands before it), are cut by the pattern itself, on the whole text.
        """
        if "  " in text or BLANK_INSIDE.search(text):
            return self.split(text)
        parts = text.split(" ")
        return [parts[0], *map(" ".__add__, parts[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.chunked(t) if t else [] for t in texts]
        here = {c for cs in cut for c in cs}
        known = self.known_ids
        if missing := here.difference(known):
            if len(known) + len(missing) > MEMO:
                known.clear()
                missing = here
            self._learn(missing)
        out = [b"".join(map(known.__getitem__, cs)) for cs in cut]
        for c in self.long:
            known.pop(c, None)
        self.long = []
        return out

    def check(self, ids: np.ndarray) -> None:
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.tokens) and self.known[ids].all()):
            raise ValueError("ids that no token has")

    def joined(self, ids: list[int]) -> bytes:
        """The bytes of ids that have been checked."""
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        self.check(np.asarray(ids, np.int64))
        return self.joined(ids)


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _spec(path, pattern):
    return path or default_path(), pattern or default_pattern()


def _id_lists(blobs: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    flat = np.frombuffer(b"".join(blobs), "<u4").astype(np.int32)
    ends = np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs])]).astype(np.int32)
    return flat, ends


def encode_rows(docs: DataFrame, path: str | None = None, pattern: str | None = None, columns: list[str] | None = None, confirm: bool = False) -> DataFrame:
    """The given columns of docs (all, if none are given), with ids array<int> and offsets array<int>; confirm decodes the ids again and raises where they don't give the text.

    offsets: where each token begins in the UTF-8 bytes of the text. Columns of docs named ids or offsets give way.
    """
    path, pattern = _spec(path, pattern)
    prepare(docs.sparkSession)
    kept = [c for c in (columns or docs.columns) if c not in ("ids", "offsets")]
    frame = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")
    schema = T.StructType([*(frame.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))])

    def run(iterator):
        c = codec(path, pattern)
        for b in iterator:
            texts = b.column("text").to_pylist()
            flat, ends = _id_lists(c.encode(texts))
            if confirm:
                c.check(flat)
                for t, x, y in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    if c.joined(flat[x:y].tolist()) != (t or "").encode("utf-8", "surrogatepass"):
                        raise ValueError("a text's ids don't decode to it")
            size = c.sizes[flat]
            begin = np.cumsum(size) - size
            counts = np.diff(ends)
            first = np.zeros(len(counts), np.int64)
            first[counts > 0] = begin[ends[:-1][counts > 0]]
            at = (begin - np.repeat(first, counts)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (flat, at)]
            yield pa.record_batch([*(b.column(k) for k in kept), *lists], [*kept, "ids", "offsets"])
        c.forget()

    return frame.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids, offsets of every text."""
    return encode_rows(docs, path, pattern, ["doc_id"])


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes, text of every row's ids."""
    path, pattern = _spec(path, pattern)
    prepare(encoded.sparkSession)

    def run(iterator):
        c = codec(path, pattern)
        for b in iterator:
            got = [c.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(got, pa.binary()), pa.array([g.decode("utf-8", "replace") for g in got], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes, decodes the ids again and digests both; one pass, so that ids needn't leave the worker."""
    path, pattern = _spec(path, pattern)
    prepare(docs.sparkSession)

    def run(iterator):
        c = codec(path, pattern)
        for b in iterator:
            n, a, z = [], [], []
            for blob in c.encode(b.column("text").to_pylist()):
                array = np.frombuffer(blob, "<u4")
                c.check(array)
                ids = array.tolist()
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(c.names.__getitem__, ids)).encode()).hexdigest())
                z.append(hashlib.sha256(c.joined(ids)).hexdigest())
            yield pa.record_batch([b.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        c.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
