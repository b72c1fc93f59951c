"""LM scoring: an interpolated modified Kneser-Ney model of a given order, counted in Spark, memory-mapped by workers."""

from __future__ import annotations

import gc
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import distinct, let_go_driver, mix, new_folder, pack, pieces_of, sorted_places, table, unpack, word_keys

END, BEGIN = np.uint64(0x5EED0000E0D15EED), np.uint64(0x5EED0000BE615EED)  # keys of the end token and of the context before a text
_PAIR = np.uint64(0xFF51AFD7ED558CCD)
FLUSH_TOKENS = 3_000_000  # a task sends its counts on when it has read so many
SHARD_TOKENS = 1_500_000  # training tokens for each shard of the model, about
PIECE_BYTES = 6 << 20  # of texts whose distinct grams are looked up together
SLICES = 12  # parts that a large model is made in, one after another
BUCKET = 16  # keys of a file for each entry of its directory, about
ORDER = 3  # of op8's model
GRAMS = "shard long, seen array<long>, data binary"
FIELDS = ("count", "continuation", "total", "n1", "n2", "n3")  # of a gram below the top level; the last four as a context


def local_path(folder: str) -> str:
    """The mounted path of the shared folder, which workers map into memory."""
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"the shared folder must be mounted on all machines to be mapped into memory, not {folder}")
    return parts.path


def tokens_of(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys of the `order` tokens that end at each token, oldest first; offsets of the texts).

    Each text ends with the end token; what lies before its first token is BEGIN.
    """
    hashes, offsets = word_keys(texts, lower=True)
    ends = offsets[1:] + np.arange(1, len(texts) + 1)  # where each text ends with its end token
    keys = np.empty(len(hashes) + len(texts), np.uint64)
    is_end = np.zeros(len(keys), bool)
    is_end[ends - 1] = True
    keys[~is_end] = hashes
    keys[is_end] = END
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    place = np.arange(len(keys)) - np.repeat(offsets[:-1], np.diff(offsets))
    return [np.where(place >= back, np.roll(keys, back), BEGIN) for back in range(order - 1, -1, -1)], offsets


def gram_keys(tokens: list[np.ndarray]) -> np.ndarray:
    """Hashes of grams; that of a single word is its key."""
    out = tokens[0]
    for t in tokens[1:]:
        out = mix(out * _PAIR + t)
    return out


def is_short(tokens: list[np.ndarray]) -> np.ndarray:
    """Whether grams reach further back than the one BEGIN before a text: they belong to a lower level."""
    return (tokens[0] == BEGIN) & (tokens[1] == BEGIN) if len(tokens) > 1 else np.zeros(len(tokens[0]), bool)


def pack_grams(tokens: list[np.ndarray], *columns: np.ndarray) -> bytes:
    """Grams with their columns, sorted; tokens are places in a dictionary that comes first."""
    words, _, places = distinct(np.concatenate(tokens))
    places = places.reshape(len(tokens), -1)
    width = len(words).bit_length()
    if width * len(tokens) <= 64:  # a gram's places in one value, from its first bit on
        order = sorted_places(np.bitwise_or.reduce([p.astype(np.uint64) << np.uint64(64 - width * i) for i, p in enumerate(places, 1)]))[0]
    else:
        order = np.lexsort(places[::-1])
    known = pack(np.diff(words, prepend=np.uint64(0)))
    return len(known).to_bytes(8, "little") + known + pack(np.diff(places[0][order], prepend=0), *places[1:, order], *(c[order] for c in columns))


def unpack_grams(parts: list[bytes], order: int, columns: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(tokens, columns) of all parts together."""
    rows = []
    for data in parts:
        end = 8 + int.from_bytes(data[:8], "little")
        words = np.cumsum(unpack(data[8:end], 1)[0], dtype=np.uint64)
        found = unpack(data[end:], order + columns)
        found[0] = np.cumsum(found[0], dtype=np.uint64)
        rows.append([*(words[f.astype(np.int64)] for f in found[:order]), *found[order:]])
    joined = [np.concatenate(x) for x in zip(*rows, strict=True)]
    return joined[:order], joined[order:]


def _write(path: str, *columns: np.ndarray) -> None:
    """One file, complete or absent: a task that runs twice leaves the same bytes."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with open(temporary, "wb") as f:
        for c in columns:
            f.write(np.ascontiguousarray(c).tobytes())
    os.replace(temporary, path)


def _shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _word_shard(keys: np.ndarray, bits: int) -> np.ndarray:
    return _shard(mix(keys), bits)


def _summed(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, a place of each, and its sums of the columns."""
    order, keys = sorted_places(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return (keys[first], order[first], *(np.add.reduceat(c[order], first, dtype=np.uint64) if len(first) else np.zeros(0, np.uint64) for c in columns))


def _slice(words: np.ndarray, slices: int) -> np.ndarray:
    return (mix(words) % np.uint64(slices)).astype(np.int64)


def _by_shard(shards: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shards.astype(np.uint16) if shards.max(initial=0) < 1 << 16 else shards, kind="stable")  # few bits are sorted by counting
    shards, columns = shards[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1], [True]])) if len(shards) else []
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(shards[a]), [c[a:b] for c in columns]


def _gram_shard(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    return _shard(keys, bits) if level > 1 else _word_shard(keys, bits)


def _count_grams(order: int, bits: int, slices: int):
    """Counts of the grams that end at each token, by shard and by the slice of their second-last word."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, room = [], 0

        def flush() -> pd.DataFrame:
            tokens = [np.concatenate([h.pop(0) for h in held]) for _ in range(order)]
            keys = gram_keys(tokens)
            unique, first, counts = _summed(keys, np.ones(len(keys), np.uint8))
            tokens = [t[first] for t in tokens]
            parts = _by_shard(_slice(tokens[-2], slices) << bits | _shard(unique, bits), [*tokens, counts])
            return pd.DataFrame([(s >> bits, s & (1 << bits) - 1, None, pack_grams(c[:-1], c[-1])) for s, c in parts], columns=["slice", "shard", "seen", "data"])

        for frame in frames:
            texts = [t.encode("utf-8", "replace") for t in frame.text]
            for a, b in pieces_of(texts, 1 << 22):
                held.append(tokens_of(texts[a:b], order)[0])
                room += len(held[-1][0])
                if room >= FLUSH_TOKENS:
                    yield flush()
                    held, room = [], 0
        if held:
            yield flush()

    return run


def _write_level(path: str, keys: np.ndarray, fields: list[np.ndarray]) -> None:
    """Sorted keys, and for each field one byte a key; values over 254 stand in a list."""
    big = [np.flatnonzero(f > 254) for f in fields]
    many = [x for b, f in zip(big, fields, strict=True) for x in (b.astype(np.uint64), f[b])]
    _write(path, np.array([len(keys), *map(len, big)], np.uint64), keys, *many, *(np.minimum(f, 255).astype(np.uint8) for f in fields))


def _write_grams(path: str, keys: np.ndarray, fields: list[np.ndarray], bits: int) -> None:
    """Sorted keys that share their first `bits` bits, each as its remainder after the bits that its place in a directory tells; no bit is lost.

    Values are one byte a key: a place in the list of the different ones, the most frequent first. Later places, and
    where nearly all keys have the first value all others, stand in a list, as keys do whose value is not the first.
    """
    n = len(keys)
    wide = max(0, (n // BUCKET).bit_length() - 1) if n else 0
    left = 64 - bits - wide
    inner = keys << np.uint64(bits) if bits else keys
    bucket = (inner >> np.uint64(64 - wide)).astype(np.int64) if wide else np.zeros(n, np.int64)
    rest = keys & np.uint64((1 << left) - 1)
    under = max(0, left - 32)  # bits of a remainder after its first 32
    low = [(rest >> np.uint64(8 * i)).astype(np.uint8) & np.uint8((1 << min(8, under - 8 * i)) - 1) for i in range((under + 7) // 8)]
    order = np.lexsort(fields[::-1])
    rows = np.stack([f[order] for f in fields], 1).astype(np.uint64).reshape(n, len(fields))
    first = np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])[:n]
    often = np.bincount(np.cumsum(first) - 1) if n else np.zeros(0, np.int64)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(-often, kind="stable")] = np.arange(len(often))
    values = np.empty((len(often), len(fields)), np.uint64)
    values[rank] = rows[first]
    codes = np.empty(n, np.int64)
    codes[order] = np.repeat(rank, often)
    dense = n > 0 and 8 * int((codes > 0).sum()) > n
    listed = np.flatnonzero(codes >= 255 if dense else codes > 0)
    head = np.array([n, wide, len(low), len(values), len(listed), dense], np.uint64)
    starts = np.searchsorted(bucket, np.arange((1 << wide) + 1)).astype(np.uint32)
    _write(path, head, values, starts, (rest >> np.uint64(under)).astype(np.uint32), listed.astype(np.uint32), codes[listed].astype(np.uint32), *low, np.minimum(codes, 255).astype(np.uint8) if dense else np.zeros(0, np.uint8))


def _read_grams(path: str, fields: int, bits: int, keys: np.ndarray) -> np.ndarray:
    """(field, key) values of a file of _write_grams for keys of its shard; zero for keys that are not there."""
    data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    n, wide, planes, different, listed, dense = (int(x) for x in data[:48].view(np.uint64))
    at, found = 48, []
    for kind, size in ((np.uint64, different * fields), (np.uint32, (1 << wide) + 1), (np.uint32, n), (np.uint32, listed), (np.uint32, listed), *((np.uint8, n),) * planes, (np.uint8, n * dense)):
        to = at + size * np.dtype(kind).itemsize
        found.append(data[at:to].view(kind))
        at = to
    values, starts, top, places, late, *low, small = found
    out = np.zeros((fields, len(keys)), np.int64)
    if not n:
        return out
    left = 64 - bits - wide
    bucket = (keys << np.uint64(bits) >> np.uint64(64 - wide)).astype(np.int64) if wide else np.zeros(len(keys), np.int64)
    rest, under = keys & np.uint64((1 << left) - 1), max(0, left - 32)
    above, below = (rest >> np.uint64(under)).astype(np.uint32), rest & np.uint64((1 << under) - 1)

    def low_at(place: np.ndarray) -> np.ndarray:
        known = np.zeros(len(place), np.uint64)
        for i, plane in enumerate(low):
            known |= plane[place].astype(np.uint64) << np.uint64(8 * i)
        return known

    a, ends = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    for back in range(int((ends - a).max(initial=0)).bit_length() - 1, -1, -1):  # past all with fewer in these 32 bits
        next_at = a + ((1 << back) - 1)
        less = top.take(next_at, mode="clip") < above
        less &= next_at < ends
        np.add(a, 1 << back, out=a, where=less)
    hit = np.flatnonzero((a < ends) & (top.take(a, mode="clip") == above))
    known = low_at(a[hit])
    while len(behind := hit[known < below[hit]]):  # of the few with the same, the next
        behind = behind[a[behind] + 1 < ends[behind]]
        behind = behind[top[a[behind] + 1] == above[behind]]
        if not len(behind):
            break
        a[behind] += 1
        known = low_at(a[hit])
    hit = hit[known == below[hit]]
    place = a[hit]
    codes = small[place].astype(np.int64) if dense else np.zeros(len(hit), np.int64)
    if listed:
        i = np.minimum(np.searchsorted(places, place), listed - 1)
        codes = np.where(places[i] == place, late[i], codes)
    out[:, hit] = values.reshape(-1, fields)[codes].T
    return out


def _passed_on(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """Rows of a negative shard: how many grams of a level have counts 1 to 4. They go on to the last level."""
    return pd.DataFrame([(key[0], np.sum(np.stack(frame.seen.tolist()), 0).tolist(), None)], columns=["shard", "seen", "data"])


def _merge_grams(folder: str, part: int, level: int, top: bool, bits: int, below: int):
    """Writes a shard's sorted gram hashes with their counts, and those of contexts with their sums; sends on what the next level sums up from it.

    Grams of a level are in the slice of their second-last word, so all that share their first or last words are, too. Below
    the top a gram's counts are in that slice, and its sums as a context in the slice of its last word.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return _passed_on(key, frame)
        tokens, columns = unpack_grams(frame.data.tolist(), level, 1 if top else len(FIELDS))
        keys, first, *columns = _summed(gram_keys(tokens), *columns)
        tokens = [t[first] for t in tokens]
        raw = columns[0]
        full = ~is_short(tokens) & (raw > 0)
        counts = raw if top else np.where(tokens[0] == BEGIN, raw, columns[1])
        number = part << bits | key[0]
        _write_grams(f"{folder}/{level}/{number}", keys[full], [counts[full]], bits)
        if not top:
            some = columns[2] > 0
            _write_grams(f"{folder}/{level}-contexts/{number}", keys[some], [c[some] for c in columns[2:]], bits)
        seen = [int((counts[full] == i).sum()) for i in (1, 2, 3, 4)]
        rows = [(-(level + 100 * (1 + key[0] % 64)), seen, None)]
        del keys, columns

        c, ends, high = counts[full], raw > 0, np.uint64(32)
        lower = [np.concatenate([t[ends], u[full]]) for t, u in zip(tokens[1:], tokens[:-1], strict=True)]  # the last words of grams, then the first
        del tokens
        hashes, cut = gram_keys(lower), int(ends.sum())
        last, i, count, continuation = _summed(hashes[:cut], raw[ends], full[ends])
        head, j, total, some, few = _summed(hashes[cut:], c, np.ones(len(c), np.uint64), (c == 1) | (c == 2).astype(np.uint64) << high)
        once, twice = few & np.uint64(0xFFFFFFFF), few >> high  # summed together, as are fewer than 2^32 of each
        unique, first, place = distinct(np.concatenate([last, head]))
        fields = np.zeros((len(FIELDS), len(unique)), np.uint64)
        fields[:2, place[: len(last)]] = count, continuation
        fields[2:, place[len(last) :]] = total, once, twice, some - once - twice
        lower = [t[np.concatenate([i, j + cut])[first]] for t in lower]
        for s, cut in _by_shard(_gram_shard(unique, level - 1, below), [*lower, *fields]):
            rows.append((s, None, pack_grams(cut[: level - 1], *cut[level - 1 :])))
        return pd.DataFrame(rows, columns=["shard", "seen", "data"])

    return run


FACTS = ["level", "tokens", "types", "pairs", "n1", "n2", "n3", "n4", "more"]


def _merge_words(folder: str, part: int):
    """Writes what a slice adds to a shard's words; gives how many grams of the levels above have counts 1 to 4."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return pd.DataFrame([(-key[0] % 100, 0, 0, 0, *_passed_on(key, frame).seen[0], 0)], columns=FACTS)
        (keys,), found = unpack_grams(frame.data.tolist(), 1, len(FIELDS))
        unique, _, *sums = _summed(keys, *found)
        _write_level(f"{folder}/parts/{key[0]}/{part}", unique, sums)
        return pd.DataFrame(columns=FACTS).astype("int64")

    return run


def _join_words(folder: str):
    """Writes a shard's sorted word hashes with their sums over all slices; gives what the whole model needs from it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in (s for frame in frames for s in frame.id):
            parts = [_map_level(f"{folder}/parts/{shard}/{p}", len(FIELDS)) for p in sorted(os.listdir(f"{folder}/parts/{shard}")) if p.isdigit()]
            keys = np.concatenate([p[0] for p in parts])
            columns = [np.concatenate([_values(p, np.arange(len(p[0])))[i] for p in parts]).astype(np.uint64) for i in range(len(FIELDS))]
            unique, _, *sums = _summed(keys, *columns)
            _write_level(f"{folder}/words/{shard}", unique, sums)
            count, continuation = sums[:2]
            n = [int((continuation == i).sum()) for i in (1, 2, 3, 4)] + [int((continuation > 2).sum())]
            yield pd.DataFrame([(1, int(count.sum()), int((count > 0).sum()), int(continuation.sum()), *n)], columns=FACTS)

    return run


def _map_level(path: str, fields: int) -> tuple:
    """Keys of a file of _write_level, and for each field (places of large values, these, all values as bytes)."""
    data = np.memmap(path, np.uint8, "r").view(np.ndarray)
    n, *many = (int(x) for x in data[: 8 * (1 + fields)].view(np.uint64))
    at, out = 8 * (1 + fields), []
    for kind, size in ((np.uint64, n), *((np.uint64, m) for m in many for _ in range(2)), *((np.uint8, n) for _ in many)):
        to = at + size * np.dtype(kind).itemsize
        out.append(data[at:to].view(kind))
        at = to
    return out[0], [(out[1 + 2 * i], out[2 + 2 * i], out[1 + 2 * fields + i]) for i in range(fields)]


def _values(found: tuple, place: np.ndarray) -> np.ndarray:
    """(field, place) values of a mapped file."""
    out = np.zeros((len(found[1]), len(place)), np.int64)
    for row, (big, many, small) in zip(out, found[1], strict=True):
        row[:] = small[place]
        more = np.flatnonzero(row == 255)
        row[more] = many[np.searchsorted(big, place[more])]
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from how many entries have counts 1 to 4."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.5, 0.5])  # too few entries to estimate from
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.clip(d, 0, [0, 1, 2, 3])


@dataclass
class KneserNey:
    """A model in the shared folder. Everything of the corpus's size stays in its files; workers map them."""

    folder: str
    order: int
    slices: int
    bits: int  # of a gram's hash that tell its shard within its slice
    word_bits: int
    tokens: int
    types: int
    pairs: int
    low: np.ndarray  # discounts of the unigram level, and of levels 2 to order
    high: list[np.ndarray]
    left: float  # the unigram level's share for words never seen
    shards: dict[str, np.ndarray]  # which shards of each level have a file

    def _path(self, level: str, shard: int) -> str | None:
        if not self.shards[level][shard]:
            return None  # no gram fell into it
        path = f"{self.folder}/{level}/{shard}"
        if not os.path.exists(path):
            raise FileNotFoundError(f"{path}: a file of the model is gone")
        return path

    def gram_sums(self, level: str, fields: int, grams: np.ndarray, words: np.ndarray) -> np.ndarray:
        """(field, gram) values at a level of distinct gram hashes, whose slice their words tell; zero for grams never seen."""
        out = np.zeros((fields, len(grams)), np.int64)
        shards = _slice(words, self.slices) << self.bits | _shard(grams, self.bits)
        for s, (places,) in _by_shard(shards, [np.arange(len(grams))]):
            path = self._path(level, s)
            if path:
                out[:, places] = _read_grams(path, fields, self.bits, grams[places])
        return out

    def word_sums(self, keys: np.ndarray) -> np.ndarray:
        """(field, word) sums of distinct word keys; zero for words never seen."""
        out = np.zeros((len(FIELDS), len(keys)), np.int64)
        for s, (places,) in _by_shard(_word_shard(keys, self.word_bits), [np.arange(len(keys))]):
            path = self._path("words", s)
            found = _map_level(path, len(FIELDS)) if path else None
            if found is not None and len(found[0]):
                place = np.minimum(np.searchsorted(found[0], keys[places]), len(found[0]) - 1)
                out[:, places] = np.where(found[0][place] == keys[places], _values(found, place), 0)
        return out

    def score(self, texts: list[bytes]) -> pd.DataFrame:
        """n_tokens, n_known, base_score and score (log10) of each text."""
        tokens, offsets = tokens_of(texts, self.order)
        keys, starts = tokens[-1], offsets[:-1]
        words, _, place = distinct(keys)
        sums = self.word_sums(np.append(words, BEGIN))
        count, continuation = sums[:2, :-1]
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))[place]
        p = ((continuation - self.low[np.minimum(continuation, 3)]) / max(self.pairs, 1) + self.left / (self.types + 1))[place]
        known = (count > 0)[place]
        before = np.roll(place, 1)
        before[starts] = len(words)  # BEGIN
        context = sums[2:]
        for level, high in enumerate(self.high, 2):
            _, d1, d2, d3 = high
            total, n1, n2, n3 = context
            some = np.maximum(total, 1)
            rest = (d1 * n1 + d2 * n2 + d3 * n3) / some  # what is left to a context's lower level
            total = total[before]
            grams, first, place = distinct(gram_keys(tokens[-level:]))
            counts = self.gram_sums(str(level), 1, grams, tokens[-2][first])[0]
            counts = (counts - high[np.minimum(counts, 3)])[place]
            seen = (total > 0) & ~is_short(tokens[-level:])
            p = np.where(seen, counts / np.maximum(total, 1) + rest[before] * p, p)
            if level < self.order:  # the next level's contexts end one token earlier; those that would begin before a text are short
                context = self.gram_sums(f"{level}-contexts", 4, grams, keys[first])
                before = np.roll(place, 1)
        return pd.DataFrame({
            "n_tokens": np.diff(offsets), "n_known": np.add.reduceat(known, starts, dtype=np.int64),
            "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(np.log10(p), starts),
        })


def fit_kneser_ney(documents: DataFrame, order: int = 2) -> KneserNey:
    """A model of grams of up to `order` tokens of all texts of documents(text); a null text is an empty one, which still has its end token.

    The top level and grams from the beginning of a text have counts, the others continuation counts. Gram counts
    are summed within tasks, cut into shards by gram hash, so that no frequent word makes a large shard, and
    shuffled as packed arrays. Texts are read once; their grams go packed to the shared folder, cut into slices by their
    second-last word. A slice goes through all levels as one job, and its grams and shuffles are let go of before the next, so that
    disk holds the model and one slice's shuffles. A task that runs again writes the same files. An empty table gives a model that knows no word.
    """
    if order < 2:
        raise ValueError(f"the order must be 2 at least, not {order}")
    spark = documents.sparkSession
    base = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size / 6 / SHARD_TOKENS
    slices = min(SLICES, max(1, int(shards / 2)))
    bits, word_bits = (max(0, int(np.ceil(np.log2(max(1, x))))) for x in (shards / slices, shards / 4))
    folder = new_folder(spark, "kneser-ney")
    local = local_path(folder)
    base.mapInPandas(_count_grams(order, bits, slices), f"slice int, {GRAMS}").write.partitionBy("slice").parquet(f"{folder}/grams", compression="none")
    sums = {level: np.zeros(len(FACTS) - 1, np.int64) for level in range(1, order + 1)}
    for part in range(slices):
        grams = f"grams/slice={part}"
        if os.path.isdir(f"{local}/{grams}"):
            for level, *more in _fit_slice(spark, folder, grams, part, order, bits, word_bits):
                sums[level] += more
            shutil.rmtree(f"{local}/{grams}")
            gc.collect()
            let_go_driver(spark)  # and with their plans the slice's shuffles go
    shutil.rmtree(f"{local}/grams")
    found = sorted(int(name) for name in (os.listdir(f"{local}/parts") if os.path.isdir(f"{local}/parts") else ()) if name.isdigit())
    if found:
        words = spark.createDataFrame([(s,) for s in found], "id long").repartition(len(found), "id").mapInPandas(_join_words(local), _facts_schema())
        sums[1] += np.array([r[1:] for r in words.groupBy("level").agg(*[F.sum(c) for c in FACTS[1:]]).collect()][0], np.int64)
        shutil.rmtree(f"{local}/parts")
    high = [discounts(*sums[level][3:7].tolist()) for level in range(2, order + 1)]
    tokens, types, pairs, n1, n2, n3, n4, more = sums[1].tolist()
    low = discounts(n1, n2, n3, n4)
    left = (low[1] * n1 + low[2] * n2 + low[3] * more) / pairs if pairs else 1.0
    levels = {"words": 1 << word_bits} | {f"{k}{kind}": slices << bits for k in range(2, order + 1) for kind in ("", "-contexts")}
    return KneserNey(local, order, slices, bits, word_bits, tokens, types, pairs, low, high, left, {level: _written(f"{local}/{level}", n) for level, n in levels.items()})


def _facts_schema() -> str:
    return ", ".join(f"{c} long" for c in FACTS)


def _fit_slice(spark: SparkSession, folder: str, grams: str, part: int, order: int, bits: int, word_bits: int) -> list[tuple]:
    """Makes all levels of a slice; (level, ...) sums of what is known of each, one row a level."""
    local = local_path(folder)
    rows = spark.read.schema(GRAMS).parquet(f"{folder}/{grams}")
    for level in range(order, 1, -1):
        rows = rows.groupBy("shard").applyInPandas(_merge_grams(local, part, level, level == order, bits, bits if level > 2 else word_bits), GRAMS)
    facts = rows.groupBy("shard").applyInPandas(_merge_words(local, part), _facts_schema())
    return [tuple(r) for r in facts.groupBy("level").agg(*[F.sum(c) for c in FACTS[1:]]).collect()]


def _written(folder: str, shards: int) -> np.ndarray:
    """Which of a level's shards have been written, as they stand when the model is made."""
    out = np.zeros(shards, bool)
    out[[int(name) for name in (os.listdir(folder) if os.path.isdir(folder) else ()) if name.isdigit()]] = True
    return out


def score_texts(documents: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each row of documents(doc_id, text), repeated rows each.

    Ids are integers; null ids stay null. A null or empty text is scored as its end token alone.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t.encode("utf-8", "replace") for t in frame.text]
            for a, b in pieces_of(texts, PIECE_BYTES):
                out = model.score(texts[a:b])
                out.insert(0, "doc_id", frame.doc_id.to_numpy()[a:b])
                out.insert(1, "has_id", frame.has_id.to_numpy()[a:b])
                yield out

    text = F.coalesce("text", F.lit("")).alias("text")
    ids = F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.isnotnull("doc_id").alias("has_id")
    out = documents.select(*ids, text).mapInPandas(run, "doc_id long, has_id boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_tokens", "n_known", "base_score", "score")


def held_out():
    """Whether crc32 of the id as text leaves 1 when divided by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_kneser_ney(documents.where(~held_out()), ORDER)
    return score_texts(documents, model).select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
