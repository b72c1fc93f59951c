import random

import duckdb
import numpy as np
import pytest

from nimbora.llm import suffix_dedup as sd


def by_hand(rows):
    """(doc_id, n_bytes, n_removed, n_spans, kept) of rows (doc_id, text)."""
    order = lambda d: 2**63 - 1 if d is None else d
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            first[w] = min(first.get(w, 2**63), order(d))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < order(d):
                gone[i : i + 50] = b"\1" * 50
        out.append((d, len(b), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def compared(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.remove_byte_repeats(df).collect()]
    assert sorted(got, key=repr) == sorted(by_hand(rows), key=repr)


def prose(r, n, letters="abcdefghij "):
    return "".join(r.choices(letters, k=n))


def some_rows(seed):
    """Copies, near copies, shared passages, runs of one letter, and texts that repeat within themselves."""
    r = random.Random(seed)
    shared = [prose(r, n) for n in (49, 50, 51, 60, 120, 400)]
    rows = []
    for d in range(60):
        parts = [prose(r, r.choice([0, 3, 30, 200]), r.choice(["ab", "abcdefghij ", "é漢x"])) if r.random() < 0.6 else r.choice(shared) for _ in range(r.randrange(6))]
        rows.append((d * 7 % 61, "".join(parts)))
    near = prose(r, 600)
    for d in range(100, 112):
        at = r.randrange(550)
        rows.append((d, near[:at] + r.choice("xyz") * r.randrange(3) + near[at:]))
    rows += [(200 + d, "z" * n) for d, n in enumerate((49, 50, 51, 200, 200))] + [(300, shared[5] * 3), (301, "\0" * 70 + shared[4] + "\0" * 55), (302, "\0" * 52 + shared[4])]
    return rows


SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_equal_brute_force(spark, seed):
    compared(spark.createDataFrame(some_rows(seed), SCHEMA).repartition(5))


def test_small_pieces_chunks_and_arrays(spark, monkeypatch):
    """Long texts in many parts, documents in many pieces, and keys dealt by their windows give the same rows."""
    for name, value in (("PIECE_BYTES", 700), ("CHUNK_BYTES", 150), ("BUCKET_BYTES", 2000), ("ARRAY_SUFFIXES", 20)):
        monkeypatch.setattr(sd, name, value)
    rows = [(d, t) for d, t in some_rows(3) if d < 20 or d > 99]
    pieces = list(sd._chunks([t.encode() for _, t in rows]))
    assert len(pieces) > 10
    ids = np.array([d for d, _ in rows])
    x = sd.Anchors([t.encode() for _, t in rows], ids, np.zeros(0, np.uint64))
    windows = sorted((int(d), int(w)) for d, f, e in zip(x.doc, x.first, x.last, strict=True) for w in range(f, e + 1))
    assert windows == [(i, w) for i, (_, t) in enumerate(rows) for w in range(max(0, len(t.encode()) - 49))]
    some = np.unique(x.key)[::3]
    y = sd.Anchors([t.encode() for _, t in rows], ids, some)
    assert not np.isin(some, y.key).any()
    windows = sorted((int(d), int(w)) for d, f, e in zip(y.doc, y.first, y.last, strict=True) for w in range(f, e + 1))
    assert len(windows) == len(set(windows)) == sum(max(0, len(t.encode()) - 49) for _, t in rows)


def test_keys_dealt_by_windows_give_the_same_rows(spark, monkeypatch):
    monkeypatch.setattr(sd, "HEAVY_LEAST", 2)
    compared(spark.createDataFrame(some_rows(4), SCHEMA).repartition(3))


def test_odd_documents(spark, odd_documents, no_documents):
    compared(odd_documents)
    assert sd.remove_byte_repeats(no_documents).count() == 0
    r = random.Random(5)
    text = prose(r, 300)
    compared(spark.createDataFrame([(None, text), (None, text), (4, text), (4, text[:200]), (2**63 - 1, text), (-(2**63), text[100:]), (5, ""), (5, None)], SCHEMA).repartition(3))


def brute_repeats(strings, least):
    """{repeat: its places} of strings, which can't be made longer on either side with all places."""
    places = {}
    for s, t in enumerate(strings):
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                places.setdefault(t[i:j], []).append((s, i))
    out = {}
    for text, at in places.items():
        if len(at) > 1:
            before = {strings[s][i - 1] if i else (s, i) for s, i in at}
            after = {strings[s][i + len(text)] if i + len(text) < len(strings[s]) else (s, i) for s, i in at}
            if len(before) > 1 and len(after) > 1:
                out[text] = sorted(at)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_intervals_are_the_maximal_repeats(seed):
    r = random.Random(seed)
    strings = [bytes(r.choices(b"ab", k=r.randrange(1, 25))) for _ in range(12)] + [b"abababab", b"ababab", b"\0\0\0\0\0", b"\0\0\0"]
    array = sd.EnhancedSuffixArray(np.frombuffer(b"".join(strings), np.uint8), np.array(list(map(len, strings))), 3)
    got = {}
    for n, a, b in zip(*array.repeats(3), strict=True):
        at = sorted((int(array.string[i]), int(array.at[i])) for i in range(a, b + 1))
        got[strings[at[0][0]][at[0][1] : at[0][1] + n]] = at
    assert got == brute_repeats(strings, 3)


def test_maximal_repeats_have_all_occurrences(spark):
    r = random.Random(9)
    passage = prose(r, 60)
    rows = [(d, prose(r, 40) + passage + prose(r, 40)) for d in range(6)] + [(7, prose(r, 300))]
    texts = {d: t for d, t in rows}
    groups = {}
    for x in sd.maximal_repeats(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect():
        groups.setdefault(x.repeat, set()).add((x.length, x.doc_id, x.start, texts[x.doc_id][x.start : x.start + x.length]))
    for found in groups.values():
        assert len({(n, t) for n, _, _, t in found}) == 1
        assert len(found) > 1
    assert any({d for _, d, _, _ in found} == set(range(6)) for found in groups.values())
    hit = {d: set() for d in texts}
    for found in groups.values():
        for n, d, s, _ in found:
            hit[d] |= set(range(s, s + n))
    assert all(hit[d] >= set(range(40, 100)) for d in range(6)) and not hit[7]


def test_query_equals_sql(spark):
    root = "/root/testdata/sf0.001"
    got = sd.op11_suffix_array_dedup(spark, root)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet'")
    want = con.execute(sd.SQL)
    assert [d[0] for d in want.description] == got.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall())
    assert sum(r[2] for r in rows) > 0
