import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gneiss.llm.packing import LevelPacker, _sequences, encoding, pack, token_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_same_ids_as_tokenizers(awkward):
    own, other = encoding(PATH), Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in awkward.collect()] + ["ab<|endoftext|>c", "a" * 5000, " " * 3000, "it's I'LL 12a３４\x00\x1c"]
    for text in texts:
        assert own.encode_to_numpy(text, allowed_special="all").tolist() == other.encode(text, add_special_tokens=False).ids


def test_very_long_white_space(spark):
    other = Tokenizer.from_file(PATH)
    spaces, mixed = "a" + " " * 5_000_000 + "b", "\n\n \t" * 300_000 + "x"
    for text in (spaces, "\n" * 2_000_000, mixed, " " * 99_999 + "y"):
        assert token_ids(PATH, text).tolist() == other.encode(text, add_special_tokens=False).ids
    got = pack(spark.createDataFrame([(1, spaces), (2, "c")], "doc_id bigint, text string"), PATH).toPandas()
    assert got[got.doc_id == 1].length.sum() == len(other.encode(spaces, add_special_tokens=False).ids) + 1


def test_every_id_is_in_one_piece_and_sequences_are_gapless(awkward):
    other = Tokenizer.from_file(PATH)
    got = pack(awkward.where("doc_id <> 9"), PATH, size=64, with_ids=True).toPandas()
    for doc, pieces in got.groupby("doc_id"):
        text = next(r.text for r in awkward.collect() if r.doc_id == doc) or ""
        ids = np.array([*other.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes()) and list(p.ids) == ids[at : at + p.length].tolist()
            at += p.length
        assert at == len(ids)
    filled = []
    for _, pieces in got.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == np.concatenate(([0], np.cumsum(pieces.length)[:-1])).tolist()
        filled.append(pieces.length.sum())
    assert max(filled) <= 64 and sum(x < 64 for x in filled) <= awkward.rdd.getNumPartitions()


def test_null_and_empty_text_are_the_end_id(awkward):
    got = {r.doc_id: r for r in pack(awkward.where("doc_id IN (3, 4)"), PATH).collect()}
    assert [got[k].doc_tokens for k in (3, 4)] == [1, 1]


def test_repeated_rows_null_ids_and_empty_table(awkward, empty):
    got = pack(awkward, PATH).toPandas()
    assert (got[got.doc_id == 9].start == 0).sum() == 2 and got.doc_id.isna().sum() == 1
    assert pack(empty, PATH).count() == 0


def test_level_minimises_squares():
    packer, rng = LevelPacker(16), np.random.default_rng(3)
    for _ in range(300):
        length = int(rng.integers(1, 16))
        count = packer.count.copy()
        costs = {}
        for level in range(17 - length):
            if level and not count[level]:
                continue
            now = count.copy()
            now[level] -= level > 0
            if level + length < 16:
                now[level + length] += 1
            costs[level] = int((now[1:16] ** 2).sum())
        assert costs[packer.level_for(length)] == min(costs.values())
        packer.place(length, length)


def test_open_sequences_grow_slower_than_documents():
    left = []
    for n in (2000, 20_000):
        packer, rng = LevelPacker(1024), np.random.default_rng(1)
        for length in rng.integers(1, 1024, size=n).tolist():
            packer.place(length, length)
        left.append(packer.count.sum() / n)
    assert left[1] < left[0] / 2


@pytest.mark.parametrize("n", [1, 2, 40, 600, 5000])
def test_open_sequences_keep_what_was_placed(n):
    rng = np.random.default_rng(n)
    documents = [(i, np.arange(length, dtype="<u4")) for i, length in enumerate(rng.integers(1, 1500, size=n).tolist())]
    got = list(_sequences(iter(documents), 1024))
    sizes = [sum(len(p[2]) for p in s) for s in got]
    assert max(sizes) <= 1024 and sum(x < 1024 for x in sizes) <= 1
    for doc, ids in documents:
        pieces = sorted((p[1], p[2]) for s in got for p in s if p[0] == doc) if n < 100 else None
        assert pieces is None or np.concatenate([x for _, x in pieces]).tolist() == ids.tolist()
    assert sum(sizes) == sum(len(ids) for _, ids in documents)
    moved = sum(len(p[2]) for s in got for p in s if p[4])
    assert moved <= 0.25 * sum(sizes) + 1024
