"""Keys of words, orders of hashes, and packed columns."""

import numpy as np
import pytest

from nimbora.llm import common


def test_words_have_one_key_each_whatever_stands_around_them():
    long = ["x" * n + end for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 200) for end in "ab"]
    texts = [" ".join(long), "", "a A b", " \n\t", "\0 \0\0 b\0", "zzé  zzÉ Zzé\n", "a" * 100_000, *long[::-1], "B"]
    raw = [t.encode() for t in texts]
    for lower in (False, True):
        keys, offsets = common.word_keys(raw, lower)
        want = [w.lower() if lower else w for t in raw for w in t.split()]  # bytes: A-Z only
        assert np.diff(offsets).tolist() == [len(t.split()) for t in raw]
        assert len(keys) == len(want) and len(set(zip(keys.tolist(), want, strict=True))) == len(set(want)) == len(set(keys.tolist()))
    assert common.word_keys([])[1].tolist() == [0] and common.word_keys([b""])[1].tolist() == [0, 0]


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
@pytest.mark.parametrize("values", [3, 2**20, 2**64])
def test_hashes_are_put_in_order_by_all_their_bits(n, values):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, values, n, dtype=np.uint64, endpoint=False) if values < 2**64 else rng.integers(0, 2**64, n, dtype=np.uint64)
    keys[n // 2 :] = keys[: n - n // 2] ^ rng.integers(0, 3, n - n // 2, dtype=np.uint64)  # many that differ in their last bits only
    order, ordered = common.sorted_places(keys)
    assert (order == np.argsort(keys, kind="stable")).all() and (ordered == keys[order]).all()
    some, first, inverse = common.distinct(keys)
    assert some.tolist() == np.unique(keys).tolist() and (keys[first] == some).all() and (some[inverse] == keys).all()


def test_packed_columns_come_back_and_zero_planes_are_left_out():
    columns = [np.arange(1000), np.zeros(1000), np.full(1000, 2**64 - 1, np.uint64), np.arange(1000) * 2**40, np.ones(1000, bool)]
    data = common.pack(*columns)
    assert all((a == np.asarray(b).astype(np.uint64)).all() for a, b in zip(common.unpack(data, 5), columns, strict=True))
    assert int.from_bytes(data[:8], "little") < 1000 * (2 + 0 + 8 + 7 + 1) + 100
    assert [len(x) for x in common.unpack(common.pack(np.zeros(0, np.int64), np.zeros(0)), 2)] == [0, 0]
