"""Suffix-array dedup of bytes: repeats of at least 50 bytes as intervals of common prefixes in enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import mix, new_folder, pack, powers, table, tidy, unpack

WINDOW = 50  # bytes that a repeat has at least
SEED = 20  # bytes of an anchor
PIECE_BYTES = 4 << 20  # text of one row of the table of pieces; a longer document is a piece of its own
CHUNK_BYTES = 1 << 20  # text that is hashed at a time
BUCKET_BYTES = 4 << 20  # text whose anchors meet in one group, on average
ARRAY_SUFFIXES = 50_000  # suffixes that are sorted at a time, beyond those of one key
HEAVY_PARTS = 100_000  # a key with more than this part of a sample's contexts,
HEAVY_LEAST = 200  # and more than so many, is dealt by its windows
SAMPLED_PIECES = 16  # the sample has so many pieces at least, or a hundredth of all
_BASE = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 32) - 1)
_KEY_SHIFT, _CONTEXT_SHIFT = np.uint64(16), np.uint64(8)  # keys meet by 48 bits, contexts of a key are told apart by 56
_NO_ID = 2**63 - 1


def stored(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder, compression=codec)
    return df.sparkSession.read.parquet(folder)


class Anchors:
    """The anchors of some texts, sorted by key and context.

    Each 50-byte window of one text chooses its smallest 20-byte hash, the first of equals, so equal windows choose the same place
    wherever they stand. Consecutive windows that choose one place are an anchor: its key is that hash, its context the
    bytes from the first window's start to the last one's end, 80 at most. Every window lies in one context only. Windows
    whose key is in `heavy` are contexts of their own, with their hash as key.

    doc, first, last: the text, and where the first and the last window begin; entry: the number of the distinct pair of key
    and context; key, context, start: of each entry, with the place of its first anchor (that of the smallest id).
    """

    def __init__(self, texts: list[bytes], ids: np.ndarray, heavy: np.ndarray):
        parts = [_chunk_anchors(*chunk, heavy) for chunk in _chunks(texts)]
        doc, first, last, key, context = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        order = _sorted(key, context, ids[doc])
        self.doc, self.first, self.last, key, context = doc[order], first[order], last[order], key[order], context[order]
        new = _changes(key) | _changes(context)
        self.start = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        self.key, self.context = key[self.start], context[self.start]

    def buckets(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, first entry of each with the end): entries are in the order of buckets."""
        bucket = (self.key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
        begins = np.flatnonzero(_changes(bucket))
        return bucket[begins].astype(np.int64), np.append(begins, len(bucket))


def _changes(values: np.ndarray) -> np.ndarray:
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal values."""
    edges = np.append(np.flatnonzero(_changes(values)), len(values)).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


def _sorted(key: np.ndarray, context: np.ndarray, did: np.ndarray) -> np.ndarray:
    """The order by key, context and id; only rows that share a key are sorted by all three."""
    order = np.argsort(key)
    same = ~_changes(key[order])
    same[:-1] |= same[1:]
    some = order[same]
    order[same] = some[np.lexsort((did[some], context[some], key[some]))]
    return order


def _chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts' numbers, where in them each part begins, parts): every window lies whole in one part."""
    docs, begins, parts, room = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - WINDOW + 1, 0), CHUNK_BYTES):
            part = text[at : at + CHUNK_BYTES + WINDOW - 1]
            if parts and room + len(part) > CHUNK_BYTES:
                yield docs, begins, parts
                docs, begins, parts, room = [], [], [], 0
            docs.append(i)
            begins.append(at)
            parts.append(part)
            room += len(part)
    if parts:
        yield docs, begins, parts


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers, kept for texts of a chunk's size."""
    if n > CHUNK_BYTES + WINDOW:
        return powers(base, n)
    if len(_POWERS.get(int(base), ())) < n:
        _POWERS[int(base)] = powers(base, CHUNK_BYTES + WINDOW)
    return _POWERS[int(base)][:n]


def _sums(buf: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, from which the hash of any stretch follows by one difference."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LETTERS[buf] * _powers(_BASE, len(buf)), out=out[1:])
    return out


def _cut(values: np.ndarray, bits: np.uint64) -> np.ndarray:
    return mix(values) >> bits << bits


def _chunk_anchors(docs: list[int], begins: list[int], parts: list[bytes], heavy: np.ndarray) -> tuple[np.ndarray, ...]:
    buf = np.frombuffer(b"".join(parts), np.uint8)
    n = len(buf)
    sums, inverse = _sums(buf), _powers(_INVERSE, n + 1)
    span = lambda first, end: mix((sums[end] - sums[first]) * inverse[first])
    seeds = mix((sums[SEED:] - sums[:-SEED]) * inverse[: n - SEED + 1])
    least = seeds & ~_PLACE | np.arange(len(seeds), dtype=np.uint64)  # of equal upper halves the first place is the least
    have, want = 1, WINDOW - SEED + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths)
    part = np.repeat(np.arange(len(parts)), lengths - WINDOW + 1)
    own = lengths - WINDOW + 1
    start = np.arange(len(part)) + np.repeat(ends - lengths - (np.cumsum(own) - own), own)
    place = (least[start] & _PLACE).astype(np.int64)
    new = _changes(place) | _changes(part)
    begin = np.flatnonzero(new)
    last = start[np.append(begin[1:], len(start)) - 1]
    first, place, part = start[begin], place[begin], part[begin]
    key = _cut(seeds[place], _KEY_SHIFT)
    context = span(first, last + WINDOW) + (place - first).astype(np.uint64)
    if len(heavy) and (many := np.isin(key, heavy)).any():
        count = (last - first + 1)[many]
        window = np.repeat(first[many] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        digest = span(window, window + WINDOW)
        rest = ~many
        part = np.concatenate([part[rest], np.repeat(part[many], count)])
        first, last = np.concatenate([first[rest], window]), np.concatenate([last[rest], window])
        key, context = np.concatenate([key[rest], _cut(digest + np.uint64(1), _KEY_SHIFT)]), np.concatenate([context[rest], digest])
    shift = np.asarray(begins, np.int64)[part] - (ends - lengths)[part]
    return np.asarray(docs, np.int64)[part], first + shift, last + shift, key, mix(context) >> _CONTEXT_SHIFT


# ---- pieces: rows of a table that hold some documents each ----


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    number, rows, room = TaskContext.get().partitionId() << 32, [], 0

    def piece() -> pd.DataFrame:
        blob = b"".join(r[2] for r in rows)
        packed = pa.compress(blob, codec="zstd", asbytes=True)
        columns = (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint8), np.array([len(r[2]) for r in rows], np.int64))
        return pd.DataFrame({"piece": [number], **{c: [a.tobytes()] for c, a in zip(("dids", "known", "sizes"), columns, strict=True)}, "blob": [packed]})

    for frame in frames:
        for row in zip(frame.did, frame.known, frame.body, strict=True):
            if rows and room + len(row[2]) > PIECE_BYTES:
                yield piece()
                number, rows, room = number + 1, [], 0
            rows.append(row)
            room += len(row[2])
    if rows:
        yield piece()


def _texts(row) -> tuple[np.ndarray, list[bytes]]:
    """(ids, texts) of a piece."""
    sizes = np.frombuffer(row.sizes, np.int64)
    ends = np.cumsum(sizes)
    blob = pa.decompress(row.blob, decompressed_size=int(ends[-1]), codec="zstd", asbytes=True) if ends[-1] else b""
    return np.frombuffer(row.dids, np.int64), [blob[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _over(base: int, dids: np.ndarray) -> np.ndarray:
    """Ids as distances from a smaller one, which are small numbers mostly."""
    return dids.astype(np.uint64) - np.uint64(base % 2**64)


def _from(base: int, distances: np.ndarray) -> np.ndarray:
    return (distances + np.uint64(base % 2**64)).astype(np.int64)


def _common_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n): keys with several contexts in a piece and how many, and under a null key how many all have."""
    for frame in frames:
        for row in frame.itertuples(index=False):
            dids, texts = _texts(row)
            x = Anchors(texts, dids, np.zeros(0, np.uint64))
            begins = np.flatnonzero(_changes(x.key))
            count = np.diff(np.append(begins, len(x.key)))
            some = count > 1
            keys = pd.array(x.key[begins[some]].view(np.int64), dtype="Int64")
            yield pd.DataFrame({"key": keys.insert(0, pd.NA), "n": np.append(len(x.key), count[some])})


def _entries(buckets: int, heavy: np.ndarray):
    """(bucket, piece, base, data): a piece's distinct keys and contexts, each with its smallest id and whether it has another."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                dids, texts = _texts(row)
                x = Anchors(texts, dids, heavy)
                if not len(x.key):
                    continue
                least = dids[x.doc[x.start]]
                more = dids[x.doc[np.append(x.start[1:], len(x.doc)) - 1]] > least
                base, (number, cut) = int(dids.min()), x.buckets(buckets)
                data = [pack(np.diff(x.key[a:b] >> _KEY_SHIFT, prepend=np.uint64(0)), x.context[a:b], _over(base, least[a:b]), more[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pd.DataFrame({"bucket": number, "piece": row.piece, "base": base, "data": data})

    return tidy(run)


def _gathered(frame: pd.DataFrame, columns: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(columns of all rows one after another, the row and the place in it of each)."""
    parts = [unpack(d, columns) for d in frame.data]
    sizes = [len(p[0]) for p in parts]
    for p in parts:
        p[0] = np.cumsum(p[0], dtype=np.uint64)
    row = np.repeat(np.arange(len(parts)), sizes)
    return [np.concatenate(c) for c in zip(*parts, strict=True)], row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _judged(frame: pd.DataFrame) -> pd.DataFrame:
    """(piece, bucket, data): which of a piece's entries are in another document too, the smallest of these, and whether the key has other contexts."""
    (key, context, over, more), row, place = _gathered(frame, 4)
    bases = frame.base.to_numpy()
    did = (over + bases.astype(np.uint64)[row]).astype(np.int64)
    order = _sorted(key, context, did)
    key, context, did, more, row, place = (c[order] for c in (key, context, did, more.astype(bool), row, place))
    new_key = _changes(key)
    new = new_key | _changes(context)
    of_key, of_context = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    first = did[new][of_context]
    begins = np.flatnonzero(new_key)
    single = np.minimum.reduceat(did, begins) == np.maximum.reduceat(did, begins)
    single &= ~np.logical_or.reduceat(more, begins)
    several = (np.bincount(of_key, weights=new) > 1) & ~single
    other = several[of_key]
    told = np.flatnonzero(other | more | (did > first))
    told = told[np.lexsort((place[told], row[told]))]
    out = []
    for a, b in _runs(row[told]):
        t, r = told[a:b], row[told[a]]
        out.append((frame.piece.iloc[r], frame.bucket.iloc[r], pack(np.diff(place[t].astype(np.uint64), prepend=np.uint64(0)), _over(int(bases[r]), first[t]), other[t])))
    return pd.DataFrame(out, columns=["piece", "bucket", "data"])


def _answers(x: Anchors, dids: np.ndarray, answers, buckets: int) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """(smallest id of each entry, or the largest number, whether its key has other contexts, first entry of each bucket)."""
    first, other = np.full(len(x.key), _NO_ID, np.int64), np.zeros(len(x.key), bool)
    number, cut = x.buckets(buckets)
    begin = dict(zip(number.tolist(), cut[:-1].tolist(), strict=True))
    for a in answers:
        place, over, flag = unpack(a["data"], 3)
        at = begin[a["bucket"]] + np.cumsum(place).astype(np.int64)
        first[at], other[at] = _from(int(dids.min()), over), flag.astype(bool)
    return first, other, begin


def _contexts(buckets: int, heavy: np.ndarray):
    """(bucket, piece, data, body): the contexts of keys that have several, by the document that has each first."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                dids, texts = _texts(row)
                x = Anchors(texts, dids, heavy)
                first, other, begin = _answers(x, dids, row.answers, buckets)
                mine = np.flatnonzero(other & (dids[x.doc[x.start]] == first))
                bucket = ((x.key[mine] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                out = []
                for a, b in _runs(bucket):
                    m, s = mine[a:b], x.start[mine[a:b]]
                    body = [texts[d][f : e + WINDOW] for d, f, e in zip(x.doc[s].tolist(), x.first[s].tolist(), x.last[s].tolist(), strict=True)]
                    data = pack(np.diff(x.key[m] >> _KEY_SHIFT, prepend=np.uint64(0)), x.context[m], first[m].view(np.uint64), np.fromiter(map(len, body), np.uint64, len(body)), m - begin[bucket[a]])
                    out.append((bucket[a], row.piece, data, pa.compress(b"".join(body), codec="zstd", asbytes=True)))
                yield pd.DataFrame(out, columns=["bucket", "piece", "data", "body"])

    return tidy(run)


class EnhancedSuffixArray:
    """The sorted suffixes of some strings that are at least `least` bytes long, and the common prefixes of neighbours.

    string, at: which string a suffix belongs to and where it begins; lcp[i]: bytes that it has in common with the one before.
    Suffixes whose first `least` bytes no other one has are left out, as they are in no interval.
    """

    def __init__(self, buf: np.ndarray, lengths: np.ndarray, least: int = WINDOW):
        begins = np.cumsum(lengths) - lengths
        own = np.maximum(lengths - least + 1, 0)
        string = np.repeat(np.arange(len(lengths)), own)
        at = np.arange(len(string)) - np.repeat(np.cumsum(own) - own, own)
        place = begins[string] + at
        sums = _sums(buf)
        head = (sums[place + least] - sums[place]) * _powers(_INVERSE, len(buf) + 1)[place]
        _, group, count = np.unique(head, return_inverse=True, return_counts=True)
        some = count[group] > 1
        string, at, place = string[some], at[some], place[some]
        left = lengths[string] - at
        width = int(left.max()) if len(left) else 1
        inside = np.arange(width) < left[:, None]
        rows = np.where(inside, np.append(buf, np.zeros(width, np.uint8))[place[:, None] + np.arange(width)], 0).astype(np.uint8)
        order = np.lexsort((left, rows.view(f"S{width}").ravel()))
        self.string, self.at, left, rows = string[order], at[order], left[order], rows[order]
        differ = np.concatenate([rows[1:] != rows[:-1], np.ones((max(len(rows) - 1, 0), 1), bool)], axis=1)
        self.lcp = np.zeros(len(rows), np.int64)
        self.lcp[1:] = np.minimum(differ.argmax(axis=1), np.minimum(left[1:], left[:-1]))
        before = place[order] - 1
        self.left = np.where(self.at > 0, buf[np.maximum(before, 0)].astype(np.int16), -1)  # the byte before; none at a string's start

    def repeats(self, least: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, first, last): the maximal repeats as intervals of the array, found by one scan with a stack.

        An interval is kept when its suffixes are not all preceded by the same byte; what begins a string counts as preceded by nothing that another has.
        """
        found, stack = [], []
        lcp = np.append(self.lcp, 0)
        places = np.flatnonzero((lcp >= least) | np.append(False, lcp[:-1] >= least))  # an interval's end is where its prefix is shorter
        for i, common in zip(places.tolist(), lcp[places].tolist(), strict=True):
            begin = i - 1
            while stack and stack[-1][0] > common:
                length, begin = stack.pop()
                found.append((length, begin, i - 1))
            if common >= least and (not stack or stack[-1][0] < common):
                stack.append((common, begin))
        length, first, last = np.array(found, np.int64).reshape(-1, 3).T
        diverse = np.concatenate([[0], np.cumsum((self.left[1:] != self.left[:-1]) | (self.left[1:] < 0))]) if len(self.left) else np.zeros(1, np.int64)
        kept = diverse[last] > diverse[first]
        return length[kept], first[kept], last[kept]


def _members(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval, place) of all suffixes of intervals."""
    n = last - first + 1
    interval = np.repeat(np.arange(len(n)), n)
    return interval, np.arange(len(interval)) - np.repeat(np.cumsum(n) - n, n) + first[interval]


def covered(buf: np.ndarray, lengths: np.ndarray, dids: np.ndarray) -> np.ndarray:
    """Which bytes of the strings lie in a repeat that also stands in a string of a smaller id."""
    array = EnhancedSuffixArray(buf, lengths)
    length, first, last = array.repeats()
    edges = np.zeros(len(buf) + 1, np.int64)
    if len(length):
        own = dids[array.string]
        least = np.minimum.reduceat(np.append(own, _NO_ID), np.column_stack([first, last + 1]).ravel())[::2]
        interval, place = _members(first, last)
        later = own[place] > least[interval]
        interval, place = interval[later], place[later]
        begin = (np.cumsum(lengths) - lengths)[array.string[place]] + array.at[place]
        np.add.at(edges, begin, 1)
        np.add.at(edges, begin + length[interval], -1)
    return np.cumsum(edges)[:-1] > 0


def _distinct_contexts(frame: pd.DataFrame):
    """The rows, places and context of each entry, and the begins, sizes, ids, keys, bytes and hashes of a bucket's contexts."""
    (key, context, did, size, place), row, _ = _gathered(frame, 5)
    total = np.bincount(row, weights=size, minlength=len(frame)).astype(np.int64)
    buf = np.concatenate([np.frombuffer(pa.decompress(b, decompressed_size=int(n), codec="zstd", asbytes=True), np.uint8) for b, n in zip(frame.body, total, strict=True)])
    size = size.astype(np.int64)
    begin = np.cumsum(size) - size
    order = np.lexsort((context, key))
    new = _changes(key[order]) | _changes(context[order])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    return row, place.astype(np.int64), number, begin[one], size[one], did[one].view(np.int64), key[one] << _KEY_SHIFT, buf, context[one]


def _cuts(size: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole keys with so many suffixes as are sorted at a time."""
    suffixes = np.append(0, np.cumsum(np.maximum(size - WINDOW + 1, 0)))
    begin = 0
    for end in np.append(np.flatnonzero(_changes(key))[1:], len(key)).tolist():
        if suffixes[end] - suffixes[begin] > ARRAY_SUFFIXES or end == len(key):
            yield begin, end
            begin = end


def _places(begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begin, lengths)


def _array_runs(frame: pd.DataFrame) -> pd.DataFrame:
    """(piece, bucket, data): the parts of a bucket's contexts that stand in a document with a smaller id, by entry."""
    row, place, number, begin, size, did, key, buf, _ = _distinct_contexts(frame)
    runs = []
    for a, b in _cuts(size, key):
        lengths = size[a:b]
        gone = covered(buf[_places(begin[a:b], lengths)], lengths, did[a:b])
        string = np.repeat(np.arange(a, b), lengths)
        edge = _changes(gone) | _changes(string)
        starts = np.flatnonzero(edge)
        stops = np.append(starts[1:], len(gone))
        hit = gone[starts]
        starts, stops = starts[hit], stops[hit]
        offset = np.cumsum(lengths) - lengths
        runs.append(np.stack([string[starts], starts - offset[string[starts] - a], stops - offset[string[starts] - a]]))
    context, first, last = np.concatenate(runs, axis=1)
    # each context's runs go to all pieces that sent it
    count = np.bincount(context, minlength=len(size))
    from_run = np.cumsum(count) - count
    times = count[number]
    source = np.repeat(np.arange(len(number)), times)
    run = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times) + from_run[number[source]]
    order = np.argsort(row[source], kind="stable")
    source, run = source[order], run[order]
    out = []
    for a, b in _runs(row[source]):
        r = row[source[a]]
        out.append((frame.piece.iloc[r], frame.bucket.iloc[r], pack(place[source[a:b]], first[run[a:b]], last[run[a:b]])))
    return pd.DataFrame(out, columns=["piece", "bucket", "data"])


def _cut_out(buckets: int, heavy: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                dids, texts = _texts(row)
                sizes = np.frombuffer(row.sizes, np.int64)
                begins = np.cumsum(sizes) - sizes
                edges = np.zeros(int(sizes.sum()) + 1, np.int64)
                if row.answers is not None and len(row.answers):
                    x = Anchors(texts, dids, heavy)
                    first, other, begin = _answers(x, dids, row.answers, buckets)
                    whole = np.flatnonzero(dids[x.doc] > first[x.entry])
                    np.add.at(edges, begins[x.doc[whole]] + x.first[whole], 1)
                    np.add.at(edges, begins[x.doc[whole]] + x.last[whole] + WINDOW, -1)
                    ends = np.append(x.start[1:], len(x.doc))
                    for a in row.runs if row.runs is not None else ():
                        place, low, high = unpack(a["data"], 3)
                        entry = begin[a["bucket"]] + place.astype(np.int64)
                        of, anchor = _members(x.start[entry], ends[entry] - 1)  # every anchor of the entry in the document that has it first
                        own = dids[x.doc[anchor]] == first[x.entry[anchor]]
                        of, anchor = of[own], anchor[own]
                        at = begins[x.doc[anchor]] + x.first[anchor]
                        np.add.at(edges, at + low.astype(np.int64)[of], 1)
                        np.add.at(edges, at + high.astype(np.int64)[of], -1)
                gone = np.cumsum(edges)[:-1] > 0
                rows = []
                for text, a, n in zip(texts, begins.tolist(), sizes.tolist(), strict=True):
                    out = gone[a : a + n]
                    removed = int(out.sum())
                    kept = np.frombuffer(text, np.uint8)[~out].tobytes() if removed else text
                    rows.append((n, removed, int((_changes(out) & out).sum()) if removed else 0, kept))
                result = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])
                result.insert(0, "did", dids)
                result.insert(1, "known", np.frombuffer(row.known, np.uint8).astype(bool))
                yield result

    return tidy(run)


def remove_byte_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of documents(doc_id, text).

    A byte goes when it is covered by a string of 50 bytes that also stands in a document with a smaller doc_id; n_spans counts the maximal runs that
    go, kept has the other bytes. Strings are judged on the input and never cross documents.

    1. The texts are written as pieces of 4 MB. A piece's distinct anchors (see Anchors) go to buckets by key, packed.
    2. A bucket tells each piece which of its contexts have a smaller document (all of its bytes go there) and which keys have several contexts.
    3. Each distinct context of such keys goes to its bucket once. An enhanced suffix array over these gives their maximal repeats with all
       occurrences; what also stands in a context with a smaller first document goes back to the pieces.
    4. The pieces are cut. Exact copies and shared passages are one context each, so the arrays don't grow with the number of copies. Keys that
       have more than a 100,000th of the contexts of a sample are dealt by their 50-byte windows instead, one context each; which keys
       those are changes no result.

    A null text is empty. A null doc_id counts as 2^63 - 1. Rows with one doc_id are never repeats of each other; repeated rows give a result each.
    A text of fewer than 50 bytes stays whole. An empty table gives an empty result.
    """
    pieces, entries, answers, runs, buckets, heavy = _found(documents)
    facts = answers.groupBy("piece").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    cuts = runs.groupBy("piece").agg(F.collect_list(F.struct("bucket", "data")).alias("runs"))
    out = pieces.join(facts, "piece", "left").join(cuts, "piece", "left").mapInPandas(_cut_out(buckets, heavy), "did long, known boolean, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.select(F.when(F.col("known"), F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def _array_groups(frame: pd.DataFrame) -> pd.DataFrame:
    """(repeat, length, key, context, at): the maximal repeats of a bucket's contexts, a row for each place in each context."""
    _, _, _, begin, size, _, key, buf, context = _distinct_contexts(frame)
    out = []
    for a, b in _cuts(size, key):
        lengths = size[a:b]
        part = buf[_places(begin[a:b], lengths)]
        array = EnhancedSuffixArray(part, lengths)
        length, first, last = array.repeats()
        interval, place = _members(first, last)
        starts = (np.cumsum(lengths) - lengths)[array.string[first]] + array.at[first]
        sums = _sums(part)
        digest = mix((sums[starts + length] - sums[starts]) * _powers(_INVERSE, len(part) + 1)[starts] + length.astype(np.uint64))
        string = array.string[place] + a
        out.append(pd.DataFrame({"repeat": digest.view(np.int64)[interval], "length": length[interval], "key": key[string].view(np.int64), "context": context[string].view(np.int64), "at": array.at[place]}))
    return pd.concat(out)


def _occurrences(buckets: int, heavy: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                dids, texts = _texts(row)
                x = Anchors(texts, dids, heavy)
                first, other, _ = _answers(x, dids, row.answers, buckets)
                told = np.flatnonzero((first < _NO_ID)[x.entry])
                e = x.entry[told]
                known = np.frombuffer(row.known, np.uint8).astype(bool)[x.doc[told]]
                size = x.last[told] - x.first[told] + WINDOW
                yield pd.DataFrame({"did": dids[x.doc[told]], "known": known, "start": x.first[told], "size": size, "key": x.key[e].view(np.int64), "context": x.context[e].view(np.int64), "several": other[e]})

    return tidy(run)


def maximal_repeats(documents: DataFrame) -> DataFrame:
    """(repeat, length, doc_id, start): every occurrence of the repeats of at least 50 bytes, those of one repeat under one number.

    A repeat can't be made longer, within the stretch of at most 80 bytes around an anchor in which it was found, without losing an
    occurrence; longer repeats show as overlapping ones. start counts bytes. Texts, ids and odd rows count as in remove_byte_repeats.
    """
    pieces, contexts, answers, _, buckets, heavy = _found(documents)
    facts = answers.groupBy("piece").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    rows = stored(pieces.join(facts, "piece").mapInPandas(_occurrences(buckets, heavy), "did long, known boolean, start long, size long, key long, context long, several boolean"), "occurrences")
    groups = contexts.groupBy("bucket").applyInPandas(_array_groups, "repeat long, length long, key long, context long, at long")
    alike = rows.where("not several").select(F.xxhash64("key", "context").alias("repeat"), F.col("size").alias("length"), "did", "known", "start")
    parts = rows.where("several").join(groups, ["key", "context"]).select("repeat", "length", "did", "known", (F.col("start") + F.col("at")).alias("start"))
    out = alike.unionByName(parts).distinct()
    return out.select("repeat", "length", F.when(F.col("known"), F.col("did")).alias("doc_id"), "start")


def _found(documents: DataFrame):
    """(pieces, contexts, answers, runs, number of buckets, heavy keys) of the first three steps."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("did"), F.col("doc_id").isNotNull().alias("known"), body.alias("body"))
    pieces = stored(rows.mapInPandas(_pieces, "piece long, dids binary, known binary, sizes binary, blob binary"), "pieces", "none")
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = 1 + total // BUCKET_BYTES
    n = pieces.count()
    few = max(1, n // max(SAMPLED_PIECES, n // 100))
    keys = pieces.where(F.pmod(F.xxhash64("piece"), F.lit(few)) == 0).mapInPandas(_common_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    keys = stored(keys.where(F.col("key").isNull() | (F.col("n") > HEAVY_LEAST)), "common")
    of = keys.where("key is null").agg(F.sum("n")).first()[0] or 0
    common = keys.where(F.col("key").isNotNull() & (F.col("n") * HEAVY_PARTS > of))  # fewer than HEAVY_PARTS
    heavy = np.sort(np.array([r.key for r in common.select("key").collect()], np.int64).view(np.uint64))

    entries = pieces.mapInPandas(_entries(buckets, heavy), "bucket long, piece long, base long, data binary")
    answers = stored(entries.groupBy("bucket").applyInPandas(_judged, "piece long, bucket long, data binary"), "entries")
    facts = answers.groupBy("piece").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    contexts = pieces.join(facts, "piece").mapInPandas(_contexts(buckets, heavy), "bucket long, piece long, data binary, body binary")
    runs = stored(contexts.groupBy("bucket").applyInPandas(_array_runs, "piece long, bucket long, data binary"), "runs")
    return pieces, contexts, answers, runs, buckets, heavy


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_byte_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
r AS (SELECT doc_id, s, hash(b[s:s + {WINDOW - 1}]) AS h FROM (SELECT doc_id, b, unnest(generate_series(1, octet_length(b) - {WINDOW - 1})) AS s FROM d WHERE octet_length(b) >= {WINDOW})),
f AS (SELECT h, min(doc_id) AS first FROM r GROUP BY h),
hit AS (SELECT doc_id, s, coalesce(s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) > {WINDOW}, true)::INT AS new FROM r JOIN f USING (h) WHERE first < doc_id),
run AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM hit),
span AS (SELECT doc_id, min(s) AS a, max(s) + {WINDOW} AS e FROM run GROUP BY doc_id, k),
total AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY 1),
edge AS (SELECT doc_id, e AS a FROM span UNION ALL SELECT doc_id, 1 FROM d),
stop AS (SELECT doc_id, a AS e FROM span UNION ALL SELECT doc_id, octet_length(b) + 1 FROM d),
pair AS (SELECT * FROM (SELECT doc_id, a, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS k FROM edge) JOIN (SELECT doc_id, e, row_number() OVER (PARTITION BY doc_id ORDER BY e) AS k FROM stop) USING (doc_id, k)),
kept AS (SELECT doc_id, string_agg(substr(hex(b), (2 * a - 1)::BIGINT, (2 * (e - a))::BIGINT), '' ORDER BY a) AS x FROM pair JOIN d USING (doc_id) WHERE e > a GROUP BY 1)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(x, ''))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
