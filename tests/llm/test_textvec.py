"""Batches of bounded size, and words of texts beyond Latin-1."""

import pyarrow as pa

from cutline.llm.huffman import default_path, encoder
from cutline.llm.textvec import batches


def test_batches_are_joined_and_cut_and_lose_nothing():
    texts = [["a" * 3, None, "b" * 10, "", "é" * 4], [], ["x" * 25, "y"], [None, None]]
    frames = [pa.record_batch([pa.array(t, pa.string())], ["text"]) for t in texts]
    got = [[x for b in held for x in b.column("text").to_pylist()] for held in batches(lambda b: b.column("text"), iter(frames), 10)]
    assert sum(got, []) == sum(texts, [])
    assert all(sum(len((x or "").encode()) for x in g[:-1]) < 10 for g in got)


def test_upper_case_words_beside_others_equal_the_library():
    e = encoder(default_path())
    texts = ["— T", "İ À", "L 日", "’\nA", "IT'S — DON'T", "A<|B", None, "", "ÀÉ  x\n\nY"]
    want = [x.ids for x in e.library.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in e.encode_column(pa.array(texts))] == want
