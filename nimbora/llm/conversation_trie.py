"""Conversation prefix tries: dictionary tries of first-turn subtries, of which oversized ones are dealt anew by their next turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import new_folder, table

HEADS = 9  # a conversation begins with fewer turns of its base than this
FAMILY = 5  # conversations whose ids differ in the remainder by this share a base
KEY = 16  # bytes of a turn's digest
MOST_TURNS = 50_000  # turns of the distinct conversations that make one dictionary trie; larger subtries are dealt anew
BUCKET_TURNS = 100_000  # turns that one task turns into tries at a time
ID_BITS = 10  # ids that differ in their last bits only are joined to one text before they meet
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def _stored(df: DataFrame, what: str) -> DataFrame:
    folder = new_folder(df.sparkSession, what)
    df.write.parquet(folder, compression="zstd")
    return df.sparkSession.read.parquet(folder)


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) with each turn's digest of role and text, and the bytes of its text, in the order of turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.octet_length(text).alias("bytes")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt_sequences(sequences: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): the first turns of the family's base, then the conversation's own after as many; keys are the turns' digests one after another."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = sequences.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    df = sequences.withColumn("base", base).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    df = df.select("conv_id", F.concat(F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return df.select("conv_id", keys.alias("keys"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the ids of each sequence, whose parts come in order; only the digest so far is held."""
    last, state = None, None
    for frame in frames:
        done = []
        for sid, ids in zip(frame.sid, frame.ids, strict=True):
            if sid == last:
                state.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((last, state.hexdigest()))
            last, state = sid, hashlib.sha256(ids.encode())
        yield pd.DataFrame(done, columns=["sid", "ends"])
    if last is not None:
        yield pd.DataFrame([(last, state.hexdigest())], columns=["sid", "ends"])


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """(keys, sizes, n, conv_id, ends) of the distinct sequences: how many conversations have it, the smallest, and the digest of all their ids."""
    sid = F.md5("keys")
    part = F.shiftright("conv_id", ID_BITS)
    ids = rebuilt.groupBy(sid.alias("sid"), part.alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    ends = ids.repartition("sid").sortWithinPartitions("sid", "part").select("sid", "ids").mapInPandas(_digests, "sid string, ends string")
    distinct = rebuilt.groupBy("keys").agg(F.first("sizes").alias("sizes"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return distinct.withColumn("sid", sid).join(ends, "sid").drop("sid")


class Trie:
    """A forest of tries: each node has a dictionary from its children's first turns to their places, made when it gets one."""

    def __init__(self) -> None:
        self.tops: dict[bytes, int] = {}
        self.kids: list[dict[bytes, int] | None] = []
        self.up: list[int] = []
        self.depth: list[int] = []
        self.size: list[int] = []
        self.n: list[int] = []
        self.first: list[int] = []
        self.ends: list[str] = []

    def _node(self, up: int, depth: int, size: int) -> int:
        for column, value in ((self.kids, None), (self.up, up), (self.depth, depth), (self.size, size), (self.n, 0), (self.first, 2**63 - 1), (self.ends, NO_ENDS)):
            column.append(value)
        return len(self.up) - 1

    def add(self, gid: bytes, depth: int, keys: bytes, sizes, n: int, conv_id: int, ends: str) -> None:
        """A sequence of the subtrie gid, whose top is the turn at place `depth`."""
        at = self.tops.get(gid)
        if at is None:
            at = self.tops[gid] = self._node(-1, depth + 1, sizes[depth])
        place = depth
        while True:
            self.n[at] += n
            self.first[at] = min(self.first[at], conv_id)
            place += 1
            if place * KEY == len(keys):
                self.ends[at] = ends
                return
            key, kids = keys[place * KEY : (place + 1) * KEY], self.kids[at]
            if kids is None:
                kids = self.kids[at] = {}
            child = kids.get(key)
            if child is None:
                child = kids[key] = self._node(at, place + 1, sizes[place])
            at = child

    def totals(self) -> tuple[list[int], list[int]]:
        """(leaves, saved tokens) of each node's subtrie. Parents stand before their children, so the way back is a postorder."""
        leaves, saved = [0] * len(self.up), [0] * len(self.up)
        for i in range(len(self.up) - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            saved[i] += (self.n[i] - 1) * self.size[i]
            if self.up[i] >= 0:
                leaves[self.up[i]] += leaves[i]
                saved[self.up[i]] += saved[i]
        return leaves, saved


def _tries(frame: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the subtries of one bucket; `gid` and `pgid` only at their tops."""
    trie, parents = Trie(), {}
    for r in frame.itertuples(index=False):
        trie.add(r.gid, r.depth, r.keys, r.sizes, r.n, r.conv_id, r.ends)
        parents[r.gid] = (r.pgid, r.parent_conv)
    leaves, saved = trie.totals()
    out = pd.DataFrame({
        "conv_id": trie.first, "depth": trie.depth, "parent_conv_id": [trie.first[u] if u >= 0 else 0 for u in trie.up], "n_convs": trie.n,
        "n_children": [len(k) if k else 0 for k in trie.kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": trie.ends,
    })
    out["gid"] = out["pgid"] = None
    tops = list(trie.tops.values())
    out.loc[tops, "parent_conv_id"] = [parents[g][1] for g in trie.tops]
    out["gid"] = pd.Series(list(trie.tops), tops, dtype=object).reindex(out.index)
    out["pgid"] = pd.Series([parents[g][0] for g in trie.tops], tops, dtype=object).reindex(out.index)
    return out.astype({"gid": object, "pgid": object}).where(out.notna(), None)


def _shared(a: str, b: str):
    """How many turns two sequences begin with alike."""
    least = F.least(F.octet_length(a), F.octet_length(b)) / KEY
    differ = F.filter(F.sequence(F.lit(0), least.cast("int")), lambda i: (i == least.cast("int")) | (F.substr(F.col(a), i * KEY + 1, F.lit(KEY)) != F.substr(F.col(b), i * KEY + 1, F.lit(KEY))))
    return F.array_min(differ)


def _round(pending: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """(small groups' sequences, large groups) of one round; None where no group is large."""
    turns = (F.octet_length("keys") / KEY).cast("long") - F.col("depth")
    groups = pending.groupBy("gid", "pgid", "depth", "parent_conv").agg(
        F.sum(turns).alias("turns"), F.min(F.struct("keys", "sizes", "ends")).alias("least"), F.max("keys").alias("most"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")
    )
    large = _stored(groups.where(F.col("turns") > most), "trie-large")
    if large.isEmpty():
        return pending, None
    large = large.select("*", F.col("least.keys").alias("keys"), F.col("least.sizes").alias("sizes"), F.col("least.ends").alias("ends")).withColumn("shared", _shared("keys", "most"))
    large = _stored(large.drop("least", "most"), "trie-split")
    return pending.join(large.select("gid"), "gid", "left_anti"), large


def conversation_trie(conversations: DataFrame, most_turns: int = MOST_TURNS) -> DataFrame:
    """The nodes of the prefix trie of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    conversations(conv_id, turn, role, text). Equal rebuilt conversations become one sequence with their number before any trie
    is built. Sequences are dealt by their first turn, hashed into buckets; a bucket's tries are dictionaries of pointers, summed up in
    an iterative postorder. A subtrie of more than most_turns turns is dealt anew by the next turn in which its members differ: the
    turns that all share, which its smallest and largest sequence show, make a chain of nodes, and what lies below is
    added to it when the rounds are done. So no group is too large for a task, and the number of rounds is that of the branchings
    within large subtries.

    A null role or text is empty; a null turn stands first; of turns with one number that with the smaller digest stands first. Repeated rows are
    turns of their own. Rows without conv_id belong to no conversation. The digests of one conversation's turns (28 bytes a turn) make one row.
    Without conversations there are no nodes.
    """
    spark = conversations.sparkSession
    rebuilt = _stored(rebuilt_sequences(_stored(turn_sequences(conversations), "trie-turns")), "trie-rebuilt")
    seqs = _stored(distinct_sequences(rebuilt), "trie-sequences")
    none = F.octet_length("keys") == 0
    whole = seqs.agg(F.sum("n"), F.min("conv_id"), F.max(F.when(none, F.col("ends")))).first()
    if whole[0] is None:
        return spark.createDataFrame([], NODE)
    n, first, ends = whole
    root = F.lit(b"")
    pending = seqs.where(~none).select(F.substring("keys", 1, KEY).alias("gid"), root.alias("pgid"), F.lit(0).cast("long").alias("depth"), F.lit(first).cast("long").alias("parent_conv"), "keys", "sizes", "n", "conv_id", "ends")
    rounds = []
    while True:
        small, large = _round(pending, most_turns)
        turns = small.agg(F.sum(F.octet_length("keys") / KEY - F.col("depth"))).first()[0] or 0
        bucket = F.pmod(F.xxhash64("gid"), F.lit(1 + int(turns) // BUCKET_TURNS))
        nodes = _stored(small.groupBy(bucket.alias("bucket")).applyInPandas(_tries, NODE + ", gid binary, pgid binary"), "trie-nodes")
        rounds.append((nodes, large))
        if large is None:
            break
        facts = large.select("gid", F.col("shared").alias("__l"), F.col("conv_id").alias("__c"))
        after = pending.join(facts, "gid").where(F.octet_length("keys") > F.col("__l") * KEY)
        gid = F.unhex(F.md5(F.substr(F.col("keys"), F.lit(1), (F.col("__l") + 1) * KEY)))
        pending = _stored(after.select(gid.alias("gid"), F.col("gid").alias("pgid"), F.col("__l").cast("long").alias("depth"), F.col("__c").alias("parent_conv"), "keys", "sizes", "n", "conv_id", "ends"), "trie-pending")

    sums = [F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")]
    below, out = None, []
    for nodes, large in reversed(rounds):
        out.append(nodes.select(*COLUMNS))
        tops = nodes.where("gid is not null").select("pgid", "n_leaves", "saved_tokens")
        if large is not None:
            chain = _stored(_chains(large, below), "trie-chains")
            out.append(chain.select(*COLUMNS))
            tops = tops.unionByName(chain.where("top").select("pgid", "n_leaves", "saved_tokens"))
        below = _stored(tops.groupBy(F.col("pgid").alias("gid")).agg(*sums), "trie-below")
    top = spark.range(1).select(F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n).cast("long").alias("n_convs"), F.lit(ends or NO_ENDS).alias("ends_sha256"), root.alias("gid"))
    zero = lambda c, least=0: F.coalesce(c, F.lit(least)).cast("long").alias(c)
    top = top.join(below, "gid", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children"), zero("n_leaves", 1), zero("saved_tokens"), "ends_sha256")
    return reduce(DataFrame.unionByName, out, top)


def _chains(large: DataFrame, below: DataFrame) -> DataFrame:
    """The nodes of the turns that a large group's sequences share, with what the groups below its last one sum up to."""
    df = large.join(below, "gid", "left")
    turn = F.explode(F.sequence(F.col("depth") + 1, F.col("shared").cast("long"))).alias("d")
    own = F.aggregate(F.slice("sizes", F.col("d").cast("int"), (F.col("shared") - F.col("d") + 1).cast("int")), F.lit(0).cast("long"), lambda s, x: s + x)
    last, top = F.col("d") == F.col("shared"), F.col("d") == F.col("depth") + 1
    ended = F.octet_length("keys") == F.col("shared") * KEY
    df = df.select("*", turn)
    return df.select(
        "conv_id", F.col("d").alias("depth"), F.when(top, F.col("parent_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * own + F.coalesce("saved_tokens", F.lit(0))).cast("long").alias("saved_tokens"), F.when(last & ended, F.col("ends")).otherwise(NO_ENDS).alias("ends_sha256"),
        top.alias("top"), "pgid",
    )


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, list({{r: r, x: x}} ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS l FROM t GROUP BY 1),
k AS (SELECT conv_id, l, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % {HEADS} AS h FROM s, tab),
b AS (SELECT k.conv_id, list_concat(coalesce(s.l[1:h], []), k.l[h + 1:]) AS l FROM k LEFT JOIN s ON s.conv_id = k.conv_id - k.conv_id % {FAMILY}),
p AS (SELECT conv_id, l, len(l) AS size, unnest(generate_series(0, len(l))) AS d FROM b),
m AS (SELECT conv_id, d, size, CASE WHEN d = 0 THEN 'root' ELSE md5(l[1:d]::VARCHAR) || sha256(l[1:d]::VARCHAR) END AS node, CASE WHEN d = 1 THEN 'root' WHEN d > 1 THEN md5(l[1:d - 1]::VARCHAR) || sha256(l[1:d - 1]::VARCHAR) END AS up, CASE WHEN d > 0 THEN strlen(l[d].x) ELSE 0 END AS bytes FROM p),
n AS (SELECT node, any_value(up) AS up, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256 FROM m GROUP BY node),
c AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY 1),
pairs AS (SELECT DISTINCT a.node AS above, z.node AS below FROM m z JOIN m a ON a.conv_id = z.conv_id AND a.d <= z.d),
g AS (SELECT above AS node, count(*) FILTER (c.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::BIGINT AS saved_tokens FROM pairs JOIN n ON n.node = below LEFT JOIN c ON c.node = below GROUP BY 1)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, g.n_leaves, g.saved_tokens, n.ends_sha256
FROM n LEFT JOIN n u ON u.node = n.up LEFT JOIN c ON c.node = n.node JOIN g ON g.node = n.node
"""
