"""The files of the language model: what they hold, what they take, and that slices change nothing."""

import glob
import os

import numpy as np
import pytest

from nimbora.llm import kneser_ney


@pytest.mark.parametrize(("n", "bits", "values"), [(0, 0, 3), (1, 0, 1), (1, 5, 3), (300, 0, 2), (20_000, 3, 4), (20_000, 8, 700), (20_000, 0, 1)])
def test_grams_come_back_from_their_file(tmp_path, n, bits, values):
    rng = np.random.default_rng(n + bits)
    head = np.uint64((1 << bits) - 1) << np.uint64(64 - bits) if bits else np.uint64(0)
    keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64) | head)
    keys = np.unique(np.concatenate([keys, keys[:9] ^ np.uint64(1)]))  # some that differ in their last bit only
    fields = [rng.integers(1, values + 1, len(keys)).astype(np.uint64), (rng.random(len(keys)) < 0.02).astype(np.uint64) * np.uint64(2**33)]
    kneser_ney._write_grams(str(tmp_path / "0"), keys, fields, bits)
    other = np.setdiff1d(np.concatenate([rng.integers(0, 2**64, 500, dtype=np.uint64) | head, keys[:99] ^ np.uint64(2)]), keys)
    assert (kneser_ney._read_grams(str(tmp_path / "0"), 2, bits, keys) == np.stack(fields).astype(np.int64)).all()
    assert not kneser_ney._read_grams(str(tmp_path / "0"), 2, bits, other).any()


@pytest.mark.parametrize("order", [2, 4])
def test_slices_change_no_score_and_leave_nothing_behind(spark, monkeypatch, order):
    rng = np.random.default_rng(order)
    rows = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 300) % 3000)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one = kneser_ney.fit_kneser_ney(docs, order)
    monkeypatch.setattr(kneser_ney, "SHARD_TOKENS", 1_500)
    monkeypatch.setattr(kneser_ney, "SLICES", 3)
    many = kneser_ney.fit_kneser_ney(docs, order)
    assert (one.slices, many.slices) == (1, 3) and many.bits > 0
    got = [{r.doc_id: tuple(r)[1:] for r in kneser_ney.score_texts(docs, m).collect()} for m in (one, many)]
    assert all(np.allclose(got[0][i], got[1][i], rtol=1e-12) for i in got[0])
    levels = {f"{k}{kind}" for k in range(2, order + 1) for kind in ("", "-contexts")} - {f"{order}-contexts"}
    assert set(os.listdir(many.folder)) == levels | {"words"}


def test_a_gram_takes_less_than_its_hash_and_a_count(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k * k % 8191 + i}" for k in range(2000))) for i in range(100)], "doc_id long, text string")
    model = kneser_ney.fit_kneser_ney(docs, 2)
    files = glob.glob(f"{model.folder}/2/*")
    assert sum(map(os.path.getsize, files)) < 8 * model.pairs
