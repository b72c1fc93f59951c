"""N-gram Jaccard join: candidate blocks from necessary prefixes, joined by signature trees, then components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.llm.common import SPACE, connected_components, gram_hashes, mix, new_folder, pack, pieces_of, table, tidy, unpack, word_hashes
from nimbora.llm.url_filter import bloom_filter, maybe_listed

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100  # least similarity
FREQUENT = 500_000  # shingles that are known as frequent, at most; they only go last in the order of shingles
FLUSH = 1_500_000  # shingles that a task counts before it sends the frequent ones on
HEAVY = 20_000  # documents from which a frequent shingle makes its block without a shuffle
PREFIX_FLUSH = 1 << 19  # prefix shingles that a task packs at once
BUCKET_ROWS = 120_000  # prefix shingles of a bucket, about
GRAM_BITS = 48  # of a shingle's hash that prefixes are grouped by; a clash only proposes a pair that the sets refute
SIZE_STEPS = 2048  # steps of a size's code for each doubling
CHUNK = 256  # documents of a block that one tree holds
FAN_OUT = 8
NO_ID = -(2**63)  # stands for a null id
SEND_BYTES = 4 << 20  # of sets that a task gives out at once


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct 5-word shingles of each text, lower-cased, as sorted hashes; a shorter text is one shingle."""
    hashes, offsets = word_hashes(texts, lower=True)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    grams = gram_hashes(hashes, SHINGLE)
    inside = doc[: len(grams)] == doc[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    grams, doc = grams[inside], doc[: len(inside)][inside]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = [grams[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    for i in np.flatnonzero((np.diff(offsets) > 0) & (np.diff(offsets) < SHINGLE)):
        words = hashes[offsets[i] : offsets[i + 1]]
        out[i] = gram_hashes(np.concatenate([words, np.array([len(words)], np.uint64)]), len(words) + 1)
    return out


def set_id(grams: np.ndarray, seed: int = 0) -> int:
    """One signed 64-bit id for a set of shingles; ids of different seeds are independent of each other."""
    with np.errstate(over="ignore"):
        salt = mix(np.array([seed], np.uint64) + np.uint64(1))[0]
        x = mix(np.array([mix(grams ^ salt).sum(dtype=np.uint64) ^ (mix(~grams ^ salt).sum(dtype=np.uint64) << np.uint64(1)) ^ np.uint64(len(grams))]))
    return int(x.view(np.int64)[0])


def prefix(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The shingles of which two sets must share one to be similar enough: the first n - ceil(0.75 n) + 1.

    The order is that of the hashes, with frequent shingles last, the most frequent at the end. Any one order
    for all sets is right; this one keeps what many documents share out of the prefixes.
    """
    n = len(grams)
    take = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    if take >= n or not len(frequent):
        return grams[:take]
    place = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    often = frequent[place] == grams
    rare = grams[~often]
    if len(rare) >= take:
        return rare[:take]
    rest = grams[often][np.argsort(rank[place[often]], kind="stable")]
    return np.concatenate([rare, rest])[:take]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def bitmap(grams: np.ndarray) -> bytes:
    """One bit for each shingle in a map of at least as many bits, a power of two, as little-endian bytes."""
    bits = max(64, 1 << max(0, int(len(grams) - 1).bit_length()))
    out = np.zeros(bits // 8, np.uint8)
    at = (grams & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return out.tobytes()


class Node:
    """A node of a signature tree: the union of the bitmaps below it, and the range of the sizes.

    A set's spare is how many more shingles than bits it has. Two sets share at most as many shingles as they
    share bits, plus the smaller spare; with the union of the bits and the largest spare the same sum bounds
    every pair of sets from two nodes. Maps of different lengths are compared at the shorter one's length.
    """

    __slots__ = ("place", "below", "low", "high", "bits", "views")

    def __init__(self, place: int, below: list[Node], low: int, high: int, bits: int, views: dict):
        self.place, self.below, self.low, self.high, self.bits, self.views = place, below, low, high, bits, views

    def view(self, bits: int) -> tuple[int, int]:
        """(bits that are set, largest spare) at a map length of at most the node's."""
        got = self.views.get(bits)
        if got is None:
            if self.below:
                each = [c.view(bits) for c in self.below]
                union = 0
                for m, _ in each:
                    union |= m
                got = (union, max(s for _, s in each))
            else:
                (wide, (m, _)) = next(iter(self.views.items()))
                while wide > bits:
                    wide //= 2
                    m = (m >> wide) | (m & ((1 << wide) - 1))
                got = (m, self.low - m.bit_count())
            self.views[bits] = got
        return got


def signature_tree(sizes: list[int], maps: list[bytes]) -> Node | None:
    """The root over all sets, which are put in the order of their sizes, eight below a node."""
    level = []
    for i in sorted(range(len(sizes)), key=lambda i: sizes[i]):
        bits, m = 8 * len(maps[i]), int.from_bytes(maps[i], "little")
        level.append(Node(i, [], sizes[i], sizes[i], bits, {bits: (m, sizes[i] - m.bit_count())}))
    while len(level) > 1:
        groups = [level[i : i + FAN_OUT] for i in range(0, len(level), FAN_OUT)]
        level = [Node(-1, g, g[0].low, max(c.high for c in g), min(c.bits for c in g), {}) for g in groups]
    return level[0] if level else None


class Joined:
    """Union-find over the sets of one call; sets already joined need not be compared."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def tree_links(a: Node | None, b: Node | None, n: int, check: Callable[[int, int], bool], shift: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) that connect just the sets which the checked pairs connect; i is a place below a, j - shift one below b.

    Both trees, or one with itself, are walked together from their roots. A pair of nodes is left when the
    sizes or the shared bits can't do, and a pair of sets when it is joined already.
    """
    joined, links = Joined(n), []
    stack = [(a, b)] if a is not None and b is not None else []
    while stack:
        x, y = stack.pop()
        if DENOMINATOR * x.high < NUMERATOR * y.low or DENOMINATOR * y.high < NUMERATOR * x.low:
            continue
        if x is not y or not x.below:
            bits = min(x.bits, y.bits)
            (m, s), (o, t) = x.view(bits), y.view(bits)
            most = min((m & o).bit_count() + min(s, t), x.high, y.high)
            if (NUMERATOR + DENOMINATOR) * most < NUMERATOR * (x.low + y.low):
                continue
        if x.below and (not y.below or x.high >= y.high or x is y):
            stack += [(c, y) for c in x.below] if x is not y else [(c, d) for k, c in enumerate(x.below) for d in x.below[k:]]
        elif y.below:
            stack += [(x, c) for c in y.below]
        elif x is not y and joined.root(x.place) != joined.root(y.place + shift) and check(x.place, y.place):
            joined.up[joined.root(x.place)] = joined.root(y.place + shift)
            links.append((x.place, y.place + shift))
    return links


def links_among(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    if len(sets) == 2:
        return [(0, 1)] if similar(*sets) else []
    tree = signature_tree([len(s) for s in sets], [bitmap(s) for s in sets])
    return tree_links(tree, tree, len(sets), lambda i, j: similar(sets[i], sets[j]))


def _pieces(frame: pd.DataFrame) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, last, sets of shingles) of runs of a batch's rows, so that no more than a few texts are held twice."""
    texts = frame.text.tolist()
    for a, b in pieces_of(texts):
        yield a, b, shingle_sets([t.encode("utf-8", "replace") for t in texts[a:b]])


def _facts(seed: int):
    """Each document's set id and size, and the shingles that are frequent in what the task has read so far, each with the smallest set id that has it."""
    columns = ["kind", "doc_id", "th", "n", "cid", "lead", "map"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, ids, room = [], [], 0

        def frequent() -> pd.DataFrame:
            grams, owners = np.concatenate(held), np.repeat(np.array(ids, np.int64), [len(h) for h in held])
            order = np.argsort(grams)
            grams, owners = grams[order], owners[order]
            first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
            counts, lead = np.diff(first, append=len(grams)), np.minimum.reduceat(owners, first)
            often = counts >= 3
            return pd.DataFrame({"kind": 1, "doc_id": NO_ID, "th": 0, "n": counts[often], "cid": grams[first[often]].view(np.int64), "lead": lead[often], "map": b""})[columns]

        for frame in frames:
            for a, b, sets in _pieces(frame):
                own = [set_id(s, 2 * seed) for s in sets]
                yield pd.DataFrame({"kind": 0, "doc_id": frame.doc_id.to_numpy()[a:b], "th": frame.th.to_numpy()[a:b], "n": [len(s) for s in sets], "cid": own, "lead": [set_id(s, 2 * seed + 1) for s in sets], "map": [bitmap(s) for s in sets]})[columns]
                held += sets
                ids += own
                room += sum(map(len, sets))
                if room >= FLUSH:
                    yield frequent()
                    held, ids, room = [], [], 0
        if room:
            yield frequent()

    return run


def size_code(n: np.ndarray) -> np.ndarray:
    """Sizes on a scale of logarithms, rounded down."""
    return np.floor(np.log2(np.maximum(n, 1)) * SIZE_STEPS).astype(np.int64)


#: Codes of sizes that differ by more can't belong to similar sets.
SIZE_REACH = int(np.ceil(np.log2(DENOMINATOR / NUMERATOR) * SIZE_STEPS)) + 1


def _packed_prefixes(known, seed: int, buckets: int):
    """Prefix shingles of the distinct sets that a task reads, packed by bucket; members of heavy shingles' blocks go along as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, rank, lead = known.value
        held, room, turn = [], 0, 0

        def flush() -> pd.DataFrame:
            nonlocal turn
            ids, sizes, firsts, cuts = zip(*held, strict=True)
            lengths = np.array([len(c) for c in cuts])
            grams, cid = np.concatenate(cuts), np.repeat(np.array(ids, np.int64), lengths)
            n = np.repeat(np.array(sizes, np.int64), lengths)
            place = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            index = place < np.repeat(np.array(firsts, np.int64), lengths)
            rows = []
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                heavy = (frequent[at] == grams) & (rank[at] >= HEAVY)
                if heavy.any():
                    pairs = np.unique(np.stack([lead[at[heavy]], cid[heavy]]), axis=1)
                    rows.append((turn % buckets, 1, pack(pairs[0].view(np.uint64), pairs[1].view(np.uint64))))
                    grams, cid, n, index = (x[~heavy] for x in (grams, cid, n, index))
            key = grams >> np.uint64(64 - GRAM_BITS)
            order = np.argsort(key)
            key, facts = key[order], (2 * size_code(n) + index)[order].astype(np.uint64)
            cid = cid[order].view(np.uint64)
            bounds = np.searchsorted(key, np.array([-(-(i << GRAM_BITS) // buckets) for i in range(buckets + 1)], np.uint64))
            for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                if a < b:
                    rows.append((i, 0, pack(np.diff(key[a:b], prepend=np.uint64(0)), facts[a:b], cid[a:b])))
            turn += 1
            return pd.DataFrame(rows, columns=["bucket", "kind", "data"])

        for frame in frames:
            for _, _, sets in _pieces(frame):
                for s in sets:
                    if len(s):
                        cut = prefix(s, frequent, rank).copy()
                        held.append((set_id(s, 2 * seed), len(s), len(s) - -(-2 * NUMERATOR * len(s) // (NUMERATOR + DENOMINATOR)) + 1, cut))
                        room += len(cut)
                if room >= PREFIX_FLUSH:
                    yield flush()
                    held, room = [], 0
        if held:
            yield flush()

    return run


def _bucket_members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, cid): sets that share a prefix shingle with one of a size near enough, under the smallest id of them."""
    for _, rows in _grouped(frames, ["bucket"]):
        found = [np.stack(unpack(d, 2)).view(np.int64) for d in rows.data[rows.kind == 1]]
        packed = [unpack(d, 3) for d in rows.data[rows.kind == 0]]
        if packed:
            key = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in packed])
            facts, cid = np.concatenate([p[1] for p in packed]), np.concatenate([p[2] for p in packed]).view(np.int64)
            found.append(_near_in_size(key, facts, cid))
        if found:
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pd.DataFrame({"block": pairs[0], "cid": pairs[1]})


def _near_in_size(key: np.ndarray, facts: np.ndarray, cid: np.ndarray) -> np.ndarray:
    """(block, cid) pairs from rows (shingle, 2 * size code + whether it stands in the set's index prefix, set).

    The first shingle that two similar sets share stands in the index prefix of the smaller one: after it both
    must have enough shingles left. Of a shingle's rows in the order of size, those stay that have such a row
    near before them, or are one and have any row near after them. A gap in the sizes parts a block.
    """
    order = np.lexsort((cid, -(facts & np.uint64(1)).astype(np.int64), facts >> np.uint64(1), key))
    key, facts, cid = key[order], facts[order], cid[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (cid[1:] != cid[:-1])])
    key, facts, cid = key[new], facts[new], cid[new]
    size, index = (facts >> np.uint64(1)).astype(np.int64), (facts & np.uint64(1)).astype(bool)
    near_next = (key[1:] == key[:-1]) & (size[1:] - size[:-1] <= SIZE_REACH)
    after = index & np.append(near_next, False)
    last = np.maximum.accumulate(np.where(index, np.arange(len(key)), -1))
    last = np.concatenate([[-1], last[:-1]])
    before = (last >= 0) & (key[last] == key) & (size - size[last] <= SIZE_REACH)
    stay = after | before
    key, size, cid = key[stay], size[stay], cid[stay]
    if not len(key):
        return np.zeros((2, 0), np.int64)
    run = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] - size[:-1] > SIZE_REACH)]))
    lengths = np.diff(run, append=len(key))
    pairs = np.stack([np.repeat(np.minimum.reduceat(cid, run), lengths), cid])
    return np.unique(pairs[:, np.repeat(lengths, lengths) > 1], axis=1)


def similarity_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, class_id, component, component_id) of each row of documents(doc_id, text).

    Documents with equal sets are one class. Classes are linked when 100 * intersection >= 75 * union;
    component is a key that all linked documents share, component_id the smallest doc_id among them. A text
    without words has no shingles, is linked with nothing, and has its own doc_id as component_id and a null
    component. Null ids never are the smallest while there is another. th is a hash of the text.

    1. One pass gives each document's class, and the shingles that are frequent. A second id of each set must
       agree within a class; should two sets ever clash, the pass is repeated with other ids.
    2. The shingles of every prefix are shuffled, packed, to buckets by their hash, and form a block with those that are near
       in size, led by the smallest class. Two similar sets share such a shingle and so a block. A shingle of
       very many documents needs no shuffle: its block's leader is known from the first pass.
    3. Of a block, only those documents stay whose bitmap and size allow a link with another one in it, as a
       walk over a tree of the bitmaps finds.
    4. Blocks are cut into chunks, each with the leader. Trees join every chunk. Documents that are not linked
       with the leader, not even through other blocks, are then joined with all chunks of the block; all others
       are joined through the leader.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = documents.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    seed = 0
    while True:
        folder = new_folder(spark, "sets")
        base.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).mapInPandas(tidy(_facts(seed)), "kind int, doc_id long, th long, n long, cid long, lead long, map binary").write.parquet(folder, compression="zstd")
        facts = spark.read.parquet(folder).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))
        own = facts.where("kind = 0 and n > 0")
        classes = own.groupBy("cid").agg(F.min(F.struct("doc_id", "th")).alias("one"), F.min("lead").alias("lead"), F.max("lead").alias("other"))
        if not classes.where("lead <> other").limit(1).count():
            break
        seed += 1
    classes = classes.select("cid", "one")
    frequent = facts.where("kind = 1").groupBy("cid").agg(F.sum("n").alias("n"), F.min("lead").alias("lead")).where("n >= 6").orderBy(F.desc("n"), "cid").limit(FREQUENT).toPandas()
    shingles = own.agg(F.sum("n")).first()[0] or 0
    facts = facts.where("kind = 0").drop("kind", "lead")
    maps = facts.where("n > 0").select("cid", "n", "map").dropDuplicates(["cid"])
    facts = facts.drop("map")
    grams = frequent.cid.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    known = spark.sparkContext.broadcast((grams[order], frequent.n.to_numpy(np.int64)[order], frequent.lead.to_numpy(np.int64)[order]))
    buckets = max(1, shingles // 4 // BUCKET_ROWS)
    packed = base.select("text").mapInPandas(tidy(_packed_prefixes(known, seed, buckets)), "bucket long, kind int, data binary")
    members = packed.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(tidy(_bucket_members), "block long, cid long").distinct()
    folder = new_folder(spark, "blocks")
    members.write.parquet(folder, compression="zstd")
    members = spark.read.parquet(folder)
    known.unpersist()
    size = members.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = _possible(members.join(size, "block"), maps)
    folder = new_folder(spark, "members")
    members.write.parquet(folder, compression="zstd")
    members = spark.read.parquet(folder)

    links = _block_links(base, members, classes)
    folder = new_folder(spark, "links")
    links.write.parquet(folder, compression="zstd")
    links = spark.read.parquet(folder)
    stray = links.where("b is null").select("block", F.col("a").alias("cid"))
    links = links.where("b is not null").select("a", "b")
    if stray.limit(1).count():
        joined = connected_components(links)
        of = lambda c: joined.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        stray = stray.join(of("cid"), "cid", "left").join(of("block"), "block", "left").where(F.coalesce("of_cid", "cid") != F.coalesce("of_block", "block"))
        folder = new_folder(spark, "strays")
        stray.select("block", "cid").distinct().write.parquet(folder)
        stray = spark.read.parquet(folder)
        again = _stray_links(base, members.join(stray.select("block").distinct(), "block"), stray, classes, maps)
        folder = new_folder(spark, "more-links")
        again.write.parquet(folder)
        links = links.unionByName(spark.read.parquet(folder))
    components = connected_components(links)
    firsts = facts.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("first"))
    names = firsts.join(components, F.col("cid") == F.col("node")).groupBy("component").agg(F.min("first").alias("component_id"))
    linked = components.join(names, "component").select(F.col("node").alias("cid"), "component", "component_id")
    labels = firsts.join(linked, "cid", "left").select("cid", F.coalesce("component", "cid").alias("component"), F.coalesce("component_id", "first").alias("component_id"))
    whole = facts.where("n > 0").join(labels, "cid").unionByName(
        facts.where("n = 0").withColumn("component", F.lit(None).cast("long")).withColumn("component_id", F.col("doc_id"))
    )
    return whole.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("cid").alias("class_id"), "component", "component_id")


def _with_sets(base: DataFrame, wanted: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of wanted(cid, places) with the set of each class, from the text of its first document."""
    spark = base.sparkSession
    wanted = wanted.join(classes, "cid").select(F.coalesce("one.doc_id", F.lit(NO_ID)).alias("rid"), F.col("one.th").alias("th"), "cid", F.col("places.block").alias("blocks"), F.col("places.chunk").alias("chunks"), F.col("places.kind").alias("kinds"))
    folder = new_folder(spark, "wanted")
    wanted.write.parquet(folder, compression="zstd")
    wanted = spark.read.parquet(folder)
    keyed = base.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), "th", "text")
    bloom, blocks = bloom_filter(wanted.select(F.col("rid").cast("string").alias("key")), wanted.count())
    some = maybe_listed(keyed.withColumn("key", F.col("rid").cast("string")), bloom, blocks).drop("key")

    def sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a, b, found in _pieces(frame):
                held, room = [], 0
                for i, grams in zip(range(a, b), (s.tobytes() for s in found), strict=True):
                    n = len(frame.blocks.iloc[i])
                    held.append(pd.DataFrame({"cid": frame.cid.iloc[i], "grams": [grams] * n, "block": frame.blocks.iloc[i], "chunk": frame.chunks.iloc[i], "kind": frame.kinds.iloc[i]}))
                    room += n * (len(grams) + 64)
                    if room > SEND_BYTES:
                        yield pd.concat(held)
                        held, room = [], 0
                if held:
                    yield pd.concat(held)

    # Equal rows of one document give equal sets; they are joined as one.
    return some.join(wanted, ["rid", "th"]).mapInPandas(tidy(sets), "cid long, grams binary, block long, chunk long, kind int")


def _grouped(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Runs of rows with equal keys, also where they go on in the next frame."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        values = frame[keys].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, [len(frame)]])
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(int(v) for v in values[a])
            if held and key != last:
                yield last, pd.concat(held)
                held = []
            held.append(frame.iloc[a:b])
            last = key
    if held:
        yield last, pd.concat(held)


def _possible(members: DataFrame, maps: DataFrame) -> DataFrame:
    """members(block, cid, chunks) without those that can have no link in their block; blocks of several chunks stay whole.

    First by size: in the order of sizes a document's nearest neighbour must be near enough. Then by bitmaps.
    """
    sized = members.where("chunks = 1").select("block", "cid").join(maps.select("cid", "n"), "cid")
    w = Window.partitionBy("block").orderBy("n", "cid")  # a block of one chunk
    near = lambda small, large: F.coalesce(F.col(small) * DENOMINATOR >= F.col(large) * NUMERATOR, F.lit(False))
    sized = sized.withColumns({"before": F.lag("n").over(w), "after": F.lead("n").over(w)}).where(near("before", "n") | near("n", "after"))
    rows = sized.select("block", "cid").join(maps, "cid").repartition("block").sortWithinPartitions("block", "cid")

    def sift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (block,), group in _grouped(frames, ["block"]):
            ids, tree = group.cid.tolist(), signature_tree(group.n.tolist(), group["map"].tolist())
            found = {i for link in tree_links(tree, tree, len(ids), lambda i, j: True) for i in link}
            out += [(block, ids[i], 1) for i in found]
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["block", "cid", "chunks"])
                out = []
        yield pd.DataFrame(out, columns=["block", "cid", "chunks"])

    return rows.mapInPandas(tidy(sift), "block long, cid long, chunks int").unionByName(members.where("chunks > 1").select("block", "cid", "chunks"))


def _block_links(base: DataFrame, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(block, a, b): links found in each chunk; b is null for a document of a cut block that isn't linked with the leader."""
    place = F.struct("block", F.pmod(F.xxhash64("cid", "block"), F.col("chunks")).cast("long").alias("chunk"), F.when(F.col("chunks") > 1, 1).otherwise(0).alias("kind"))
    single = F.col("chunks") == 1
    own = members.where(single | (F.col("cid") != F.col("block"))).select("cid", place.alias("place"))
    every = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.col("block").alias("block"), c.cast("long").alias("chunk"), F.when(F.col("chunks") > 1, 1).otherwise(0).alias("kind"))))
    leaders = members.where(~single & (F.col("cid") == F.col("block"))).select("cid", every.alias("place"))
    wanted = own.unionByName(leaders).groupBy("cid").agg(F.collect_list("place").alias("places"))
    rows = _with_sets(base, wanted, classes).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "cid")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for (block, _, kind), group in _grouped(frames, ["block", "chunk", "kind"]):
            group = group.drop_duplicates("cid")
            ids = group.cid.tolist()
            sets = [np.frombuffer(g, np.uint64) for g in group.grams]
            found = links_among(sets)
            out += [(block, ids[i], ids[j]) for i, j in found]
            if kind and block in ids:
                joined = Joined(len(ids))
                for i, j in found:
                    joined.up[joined.root(i)] = joined.root(j)
                leader = joined.root(ids.index(block))
                out += [(block, c, None) for i, c in enumerate(ids) if joined.root(i) != leader]
            if len(out) > 10_000:
                yield _frame(out)
                out = []
        yield _frame(out)

    return rows.mapInPandas(tidy(join), "block long, a long, b long")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.array([r[i] for r in rows], "Int64") for i, name in enumerate(("block", "a", "b"))})


def _stray_links(base: DataFrame, members: DataFrame, strays: DataFrame, classes: DataFrame, maps: DataFrame) -> DataFrame:
    """(a, b): links of the strays of cut blocks with all members of their blocks, by pairs of chunks.

    Trees of bitmaps alone are walked first; the sets of those that may have a link in a pair of chunks follow.
    """
    n = strays.groupBy("block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("stray_chunks"))
    members = members.join(n, "block")
    strays = strays.distinct().join(members, ["block", "cid"])
    own = F.pmod(F.xxhash64("cid", "block"), F.col("stray_chunks"))
    mine = F.pmod(F.xxhash64("cid", "block"), F.col("chunks"))
    grid = lambda i, j: (i * F.col("chunks") + j).cast("long")  # noqa: E731  the pair of stray chunk i and chunk j
    left = strays.select("block", "cid", F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: grid(own, j))).alias("chunk"), F.lit(1).alias("kind"))
    right = members.select("block", "cid", F.explode(F.transform(F.sequence(F.lit(0), F.col("stray_chunks") - 1), lambda i: grid(i, mine))).alias("chunk"), F.lit(0).alias("kind"))
    cells = left.unionByName(right).join(maps, "cid").repartition("block", "chunk").sortWithinPartitions("block", "chunk", "cid")

    def walk(group: pd.DataFrame, column: str, tree: Callable, check: Callable) -> tuple[list, list, list]:
        """(ids, kinds, links by place) of the strays and the others of a pair of chunks."""
        group = group.drop_duplicates(["cid", "kind"])
        sides = [group[group.kind == k] for k in (1, 0)]
        ids, kinds = [*sides[0].cid, *sides[1].cid], [*sides[0].kind, *sides[1].kind]
        held = [*sides[0][column], *sides[1][column]]
        cut = len(sides[0])
        sizes = [*sides[0].n, *sides[1].n] if "n" in group else [len(g) // 8 for g in held]
        trees = [tree(sizes[a:b], held[a:b]) for a, b in ((0, cut), (cut, len(ids)))]
        return ids, kinds, tree_links(*trees, len(ids), lambda i, j: ids[i] != ids[cut + j] and check(held[i], held[cut + j]), cut)

    def sift(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (block, chunk), group in _grouped(frames, ["block", "chunk"]):
            ids, kinds, found = walk(group, "map", signature_tree, lambda a, b: True)
            some = sorted({i for link in found for i in link})
            yield pd.DataFrame({"block": block, "chunk": chunk, "cid": [ids[i] for i in some], "kind": [kinds[i] for i in some]})

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in _grouped(frames, ["block", "chunk"]):
            tree = lambda sizes, packed: signature_tree(sizes, [bitmap(np.frombuffer(g, np.uint64)) for g in packed])
            ids, _, found = walk(group, "grams", tree, lambda a, b: similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)))
            yield pd.DataFrame([(ids[i], ids[j]) for i, j in found], columns=["a", "b"])

    folder = new_folder(base.sparkSession, "stray-pairs")
    cells.mapInPandas(tidy(sift), "block long, chunk long, cid long, kind int").write.parquet(folder, compression="zstd")
    wanted = base.sparkSession.read.parquet(folder).groupBy("cid").agg(F.collect_list(F.struct("block", "chunk", "kind")).alias("places"))
    rows = _with_sets(base, wanted, classes).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "cid")
    return rows.mapInPandas(tidy(join), "a long, b long").where("a <> b")


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """documents without all but one of each group of linked documents: the smallest doc_id stays.

    Of rows with that doc_id the one with the smallest text hash stays, once. Texts without words all stay.
    """
    kept = documents.columns
    keys = [F.coalesce("doc_id", F.lit(NO_ID)).alias("__rid"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__th")]
    found = similarity_classes(documents.select("doc_id", "text")).where("component is not null")
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "th"))
    stay = found.groupBy("component").agg(first.alias("f")).select(F.coalesce("f.doc_id", F.lit(NO_ID)).alias("__rid"), F.col("f.th").alias("__th")).distinct()
    wordless = ~F.coalesce("text", F.lit("")).rlike("[^" + SPACE[1:])
    worded = documents.where(~wordless).select(*kept, *keys).join(stay, ["__rid", "__th"], "left_semi").dropDuplicates(["__rid", "__th"])
    return worded.select(*kept).unionByName(documents.where(wordless))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "class_id")
