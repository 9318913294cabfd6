"""Token ids in a canonical, length-limited Huffman file (operator 2).

Texts are encoded by the tokenizers library; ids are counted over all documents; package-merge gives code
lengths of at most LIMIT bits, and the canonical code follows from the lengths alone. The file is a Parquet
folder (so that Spark writes and reads it in any store, and a lost task is written again): `code` holds the
lengths, `blocks` one row for each independent block of whole documents, in ascending doc_id order over
parts: first id, doc_ids, tokens of each document, the coded bytes, and the bit offset of every CHECK-th
token. Decoding looks up LIMIT bits in one table, for all checkpoints of a block side by side.

Defined results: null text counts as empty and yields the end id alone. Repeated doc_ids stand
side by side, the shorter first; rows without a doc_id come before all others. An empty table gives an empty file. Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, prepare, work_folder
from .textvec import batches

LIMIT, CHECK, BLOCK, END = 16, 512, 1 << 16, 1
#: Words of a worker's memo before it starts anew, and new ones that one call of the library encodes.
MEMO, JOINED = 900_000, 8192
TOKENIZER = "word_bpe_49k.json"
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER[10] = 0x20
BLOCKS = "part int, block int, first long, doc_ids array<long>, counts array<int>, marks array<long>, data binary"


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, each distinct word only once.

    No token of this kind of tokenizer spans white space and none of its rules looks across it, so a text is
    encoded blank by blank. Words of Latin-1 are lower-cased first (as the tokenizer does), which leaves fewer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec))
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.size = max(vocab.values()) + 1
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._refuse_others()
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # The same model for pieces that are cut and in lower case already.
        spec["normalizer"] = None
        cutters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [spec["pre_tokenizer"]])
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in cutters if x and x["type"] == "ByteLevel")]}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.words: dict[str, bytes] = {}

    def _refuse_others(self) -> None:
        """Raises if the tokenizer doesn't split texts as this class does: at blanks, and lower-casing."""
        probe = "IT'S one2 Two,three ÉA don't"
        whole = self.library.encode(probe, add_special_tokens=False).ids
        if whole != [i for w in probe.lower().split(" ") for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("the tokenizer doesn't cut texts into lower-case words at blanks")

    @staticmethod
    def plain(text: str) -> bool:
        if "<|" in text:
            return False
        if text.isascii():
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, missing: list[str], plain: bool = False) -> None:
        """Encodes new words; plain: they are known to be within Latin-1 and in lower case.

        A word of letters alone is one piece; others are cut into pieces as the tokenizer cuts them. A piece has the ids
        that it has as a word, so one memo serves both.
        """
        known = self.words
        if not plain:
            odd = [w for w in missing if not self.plain(w)]
            known.update(zip(odd, self._bytes(odd), strict=True))
            low = {w: w.lower() for w in missing if w not in known}
            self._learn([w for w in dict.fromkeys(low.values()) if w not in known], plain=True)
            known.update({w: known[x] for w, x in low.items()})
            return
        whole = [w for w in missing if w.isalpha()]
        cut = {w: self.split(w) for w in missing if not w.isalpha()}
        new = list({p for ps in cut.values() for p in ps if p not in known}.difference(whole))
        known.update(zip(whole + new, self._encoded(whole + new), strict=True))
        for w, ps in cut.items():
            if len(ps) != 1 or ps[0] != w:
                known[w] = b"".join(map(known.__getitem__, ps))

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece: many joined by blanks in one call, as a piece's last token ends a word."""
        out = []
        for k in range(0, len(pieces), JOINED):
            some = pieces[k : k + JOINED]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            if len(ends) == len(some):
                raw, begin = ids.tobytes(), 0
                for end in ends:
                    out.append(raw[begin:end])
                    begin = end
            else:
                out += self._bytes(some)
        return out

    def _known(self, words: list[str], plain: bool = False) -> list[bytes]:
        """Ids of each of the words."""
        if missing := list(dict.fromkeys(w for w in words if w not in self.words)):
            if len(self.words) + len(missing) > MEMO:
                self.words.clear()
                missing = list(dict.fromkeys(words))
            self._learn(missing, plain)
        return list(map(self.words.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, cut into words in Python."""
        cut = []
        for t in texts:
            t = t or ""
            cut.append([w for w in (t.lower() if self.plain(t) else t).replace("\n", " ").split(" ") if w])
        here = list({w for ws in cut for w in ws})
        get = dict(zip(here, self._known(here), strict=True)).__getitem__
        return [b"".join(map(get, ws)) for ws in cut]

    def encode_column(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Texts within Latin-1 are lower-cased and cut into words as bytes, side by side; the others one by one."""
        column = column.fill_null("")
        b, offsets = _bytes_of(column)
        odd = np.zeros(len(column), bool)
        bar = np.flatnonzero(b[:-1] == 0x3C)
        for at in (np.flatnonzero(b >= 0xC4), bar[b[bar + 1] == 0x7C]):
            odd[np.searchsorted(offsets, at, side="right") - 1] = True
        if not odd.any():
            return self._encode_plain(b, offsets)
        rest = iter(self._encode_plain(*_bytes_of(column.filter(pa.array(~odd)))))
        others = iter(self.encode(column.filter(pa.array(odd)).to_pylist()))
        return [np.frombuffer(next(others), np.uint32) if o else next(rest) for o in odd.tolist()]

    def _encode_plain(self, b: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Ids of texts within Latin-1, given as the UTF-8 bytes of all of them. A word holds the blanks up to the next one, until it is looked up."""
        b = LOWER[b]
        second = np.flatnonzero(b[:-1] == 0xC3) + 1
        second = second[(b[second] >= 0x80) & (b[second] <= 0x9E) & (b[second] != 0x97)]
        b[second] += 0x20  # the capital letters of Latin-1
        inside = b != 0x20
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < len(b)]
        first[begins] = inside[begins]
        start = np.flatnonzero(first)
        ends = np.append(start, len(b)).astype(np.int32)
        words = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(b)]).dictionary_encode()
        ids = pa.array(self._known(pc.utf8_rtrim(words.dictionary, " ").to_pylist(), plain=True), pa.binary()).take(words.indices)
        flat, total = _bytes_of(ids)
        flat, cut = flat.view(np.uint32), (total // 4)[np.searchsorted(start, offsets)]
        return [flat[x:y] for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a string or binary array without nulls, and where each begins, with the end of the last."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data if data is not None else b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_ids(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """doc_id, n, ids (little-endian, two bytes each where the vocabulary allows, else four) with the end id."""
    path = path or default_path()
    prepare(docs.sparkSession)

    def run(iterator):
        e = encoder(path)
        kind = "<u2" if e.size <= 1 << 16 else "<u4"
        for held in batches(lambda b: b.column("text"), iterator):
            b = pa.Table.from_batches(held).combine_chunks()
            text = b.column("text").combine_chunks()
            text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
            ids = [np.append(x, np.uint32(end)) for x in e.encode_column(text)]
            yield pa.record_batch(
                [b.column("doc_id").combine_chunks().cast(pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([len(x) * 0 + int(kind[-1]) for x in ids], pa.int32()), pa.array([x.astype(kind).tobytes() for x in ids], pa.binary())],
                ["doc_id", "n", "width", "ids"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, width int, ids binary")


def _ids(batch) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{w}") for x, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True)]


def count(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; as many rows as the vocabulary has ids, at most."""

    def run(iterator):
        total = np.zeros(0, np.int64)
        for b in iterator:
            if b.num_rows:
                n = np.bincount(np.concatenate(_ids(b)))
                if len(n) > len(total):
                    n[: len(total)] += total
                    total = n
                else:
                    total[: len(n)] += n
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["id"].tolist(), rows["n"].tolist(), strict=True))


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal lengths of at most limit bits, by package-merge; ties by id."""
    leaves = sorted((n, i) for i, n in counts.items() if n)
    if len(leaves) > 1 << limit:
        raise ValueError(f"{len(leaves)} ids don't fit into codes of {limit} bits")
    if len(leaves) == 1:
        return {leaves[0][1]: 1}
    weight = np.array([n for n, _ in leaves], np.int64)
    n = len(weight)
    # Each level merges the leaves with packages (pairs) of the level below; only which entries are leaves is kept.
    level, is_leaf = weight, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = level[0 : len(level) // 2 * 2 : 2] + level[1 : len(level) // 2 * 2 : 2]
        both = np.concatenate([weight, pairs])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < n)
    length, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(is_leaf):
        used = int(flags[:take].sum())
        length[:used] += 1
        take = 2 * (take - used)
    return {leaves[k][1]: int(length[k]) for k in range(n)}


class Code:
    """The canonical code of some lengths: codes grow with (length, id)."""

    def __init__(self, lengths: dict[int, int]):
        ids = np.array(sorted(lengths, key=lambda i: (lengths[i], i)), np.int64)
        size = np.array([lengths[i] for i in ids.tolist()], np.int64)
        width = int(ids.max()) + 1 if len(ids) else 1
        step = (np.int64(1) << (LIMIT - size)) if len(ids) else size
        begin = np.cumsum(step) - step
        self.length = np.zeros(width, np.int64)
        self.bits = np.zeros(width, np.int64)
        self.length[ids], self.bits[ids] = size, begin  # left-aligned in LIMIT bits
        self.symbol = np.zeros(1 << LIMIT, np.int32)
        self.used = np.zeros(1 << LIMIT, np.int64)
        filled = int(step.sum())
        self.symbol[:filled], self.used[:filled] = np.repeat(ids, step), np.repeat(size, step)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bit offset of every CHECK-th id, and the coded bytes."""
        size = self.length[ids]
        at = np.cumsum(size)
        total = int(at[-1]) if len(at) else 0
        at -= size
        value = self.bits[ids] << (24 - LIMIT - (at & 7))
        out = np.zeros(total // 8 + 4)
        for k, shift in enumerate((16, 8, 0)):
            part = np.bincount((at >> 3) + k, weights=(value >> shift) & 255)
            out[: len(part)] += part[: len(out)]
        return at[::CHECK], out[: (total + 7) // 8].astype(np.uint8).tobytes()

    def decode(self, n: int, marks: np.ndarray, data: bytes) -> np.ndarray:
        """The n ids of a block: all stretches between checkpoints side by side."""
        raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        at, out = marks.astype(np.int64), np.zeros((len(marks), CHECK), np.int32)
        last = len(window) - 1
        for k in range(min(CHECK, n)):
            peek = (window[np.minimum(at >> 3, last)] >> (24 - LIMIT - (at & 7))) & ((1 << LIMIT) - 1)
            out[:, k] = self.symbol[peek]
            at += self.used[peek]
        return out.reshape(-1)[:n]


def write(tokens: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Writes the file of token_ids() rows at path; returns the code table (id, bits)."""
    spark = tokens.sparkSession
    lengths = code_lengths(count(tokens))
    table = spark.createDataFrame([(i, b) for i, b in sorted(lengths.items())], "id int, bits int")
    keep(table.coalesce(1), f"{path}/code")
    code = spark.sparkContext.broadcast(lengths)

    def run(iterator):
        from pyspark import TaskContext

        part, c, block, first = TaskContext.get().partitionId(), Code(code.value), 0, 0
        docs, ids, held = [], [], 0

        def flush():
            marks, data = c.encode(np.concatenate(ids).astype(np.int64))
            row = [[part], [block], [first], [docs], [[len(x) for x in ids]], [marks.tolist()], [data]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "block", "first", "doc_ids", "counts", "marks", "data"])

        for b in iterator:
            for d, x in zip(b.column("doc_id").to_pylist(), _ids(b), strict=True):
                docs.append(d)
                ids.append(x)
                held += len(x)
                if held >= BLOCK:
                    yield flush()
                    block, first, docs, ids, held = block + 1, first + held, [], [], 0
        if docs:
            yield flush()

    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "n", "ids").select("doc_id", "ids", "width").mapInArrow(run, BLOCKS).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    return table


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Decodes the file: doc_id, start, n_tokens and ids (or ids_crc32 instead of ids, if digest)."""
    lengths = {r.id: r.bits for r in spark.read.schema("id int, bits int").parquet(f"{path}/code").collect()}
    code = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    last = ("crc", "ids_crc32 long") if digest else ("ids", "ids array<int>")

    def run(iterator):
        c = Code(code.value)
        for b in iterator:
            for r in b.to_pylist():
                n = np.array(r["counts"], np.int64)
                ids = c.decode(int(n.sum()), np.array(r["marks"], np.int64), r["data"])
                ends = np.cumsum(n)
                if digest:
                    raw = ids.astype("<u4").tobytes()
                    got = pa.array([zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64())
                else:
                    got = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids))
                yield pa.record_batch(
                    [pa.array(r["doc_ids"], pa.int64()), pa.array(np.full(len(n), r["part"], np.int32)), pa.array(ends - n + r["first"]), pa.array(n), got],
                    ["doc_id", "part", "within", "n_tokens", last[1].split()[0]],
                )

    rows = blocks.mapInArrow(run, f"doc_id long, part int, within long, n_tokens long, {last[1]}")
    # One row for each part of the file: its ids and those of all parts before it.
    size = blocks.select("part", F.expr("aggregate(counts, 0L, (s, x) -> s + x)").alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last[1].split()[0])


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes, writes the file into the shared folder, reads it back and digests what was read."""
    spark = prepare(docs.sparkSession)
    tokens = keep(token_ids(docs, path), work_folder(spark, "token-ids"))
    folder = work_folder(spark, "huffman")
    write(tokens, folder)
    return read(spark, folder, digest=True)
