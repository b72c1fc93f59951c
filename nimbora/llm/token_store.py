"""Token ids in directly addressable codes: any token is read by its place, without decoding a block."""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nimbora.llm.common import WordRows, new_folder, no_cycles, pieces_of, table

CHUNK_BITS = 8
RANK_STEP = 512  # bits of a continuation bitmap between two entries of its rank directory
BLOCK_TOKENS = 1 << 16  # a block closes when it holds so many; one longer document makes a longer block
CACHE_ENTRIES = 500_000
PIECE_BYTES = 1 << 23  # of texts whose distinct pieces are looked up together
END_ID = 2
MAGIC = b"NDAC1\0"
_IS_PUNCTUATION, _IS_ALNUM, _LEADS_LETTERS = np.zeros((3, 256), bool)
_IS_PUNCTUATION[list(string.punctuation.encode())] = True
_IS_ALNUM[list((string.ascii_letters + string.digits).encode())] = True
_LEADS_LETTERS[[*range(0xC3, 0xCA), 0xD0, 0xD1]] = True  # first bytes of UTF-8 after which all characters are letters, but for two after C3


class DirectCodes:
    """Ids cut into levels of 8 bits.

    Level 0 has the lowest chunk of every id, level k + 1 the next chunk of those ids whose bit in level k's
    continuation bitmap is set. The rank directory holds the number of set bits before every 512th bit, so the
    place of an id in the next level is one lookup and one short count.
    """

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.levels = levels  # (chunks uint8, bitmap bytes, rank directory uint32)

    @classmethod
    def encode(cls, ids: np.ndarray) -> DirectCodes:
        left, levels = ids.astype(np.uint32), []
        while True:
            more = left >> CHUNK_BITS
            goes_on = more > 0
            ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(left), RANK_STEP), dtype=np.uint32))[:-1]]) if len(left) else []
            levels.append(((left & 255).astype(np.uint8), np.packbits(goes_on, bitorder="little"), np.asarray(ranks, np.uint32)))
            if not goes_on.any():
                return cls(levels)
            left = more[goes_on]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        """The id at place i, by one rank query for each of its chunks."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_STEP * RANK_STEP
            before = np.unpackbits(bitmap[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i, shift = int(ranks[i // RANK_STEP]) + int(before.sum()), shift + CHUNK_BITS
        return value

    def decode(self) -> np.ndarray:
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            here = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
            here[goes_on] |= out << CHUNK_BITS
            out = here
        return out

    def to_bytes(self) -> bytes:
        parts = [MAGIC, len(self.levels).to_bytes(2, "little")]
        for chunks, bitmap, ranks in self.levels:
            parts += [len(chunks).to_bytes(8, "little"), chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u4").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> DirectCodes:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        at = len(MAGIC)
        n_levels, levels = int.from_bytes(data[at : at + 2], "little"), []
        at += 2
        for _ in range(n_levels):
            n = int.from_bytes(data[at : at + 8], "little")
            sizes = [n, (n + 7) // 8, (n + RANK_STEP - 1) // RANK_STEP * 4]
            at += 8
            cuts = []
            for size in sizes:
                cuts.append(data[at : at + size])
                at += size
            levels.append((np.frombuffer(cuts[0], np.uint8), np.frombuffer(cuts[1], np.uint8), np.frombuffer(cuts[2], "<u4")))
        return cls(levels)


def cut_pieces(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(how many pieces each text has, the pieces of all texts in order), of a string array without nulls.

    A text is cut before a space, before and after a line feed, and between a letter or ASCII digit and the ASCII punctuation that
    ends a word. A pre-tokenizer of GPT-2 cuts there, too, if no other white space stands beside a space or line feed.
    The pieces are a view of the texts' bytes.
    """
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets.astype(np.int64) - offsets[0]
    begins = np.zeros(len(data) + 1, bool)  # of texts
    begins[offsets] = True
    feed = data == 10
    between = (data == 32) | feed
    cut = begins.copy()
    cut[:-1] |= between
    cut[1:] |= feed
    mark = _IS_PUNCTUATION[data]
    goes_on = np.zeros(len(data) + 1, bool)  # a run of marks
    goes_on[1:-1] = mark[1:] & mark[:-1] & ~begins[1:-1]
    first = np.flatnonzero(mark & ~goes_on[:-1])
    end = np.flatnonzero(mark & ~goes_on[1:]) + 1
    last = begins | np.append(between, True)
    some = last[end] & ~begins[first]
    first = first[some]
    before, lead = data[first - 1], data[np.maximum(first - 2, 0)]
    cut[first[_IS_ALNUM[before] | ((before & 0xC0) == 0x80) & _LEADS_LETTERS[lead] & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))]] = True
    cuts = np.flatnonzero(cut)  # with the end of all
    pieces = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
    return np.diff(np.searchsorted(cuts, offsets)), pieces


class PieceRows(WordRows):
    """Rows of ids of remembered pieces, which Arrow looks up; row 0 is that of the end."""

    def __init__(self, end: list[int]) -> None:
        super().__init__()
        self.keys = pa.array([""], pa.string())
        self.add([end])

    def of(self, pieces: pa.Array, encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """The rows of distinct pieces, none of them empty, of which those not yet known are encoded first."""
        found = pc.index_in(pieces, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        new = found < 0
        self.again[found[~new]] = True
        if new.any():
            fresh = pieces.filter(pa.array(new))
            found[new] = self.add(encode(fresh.to_numpy(zero_copy_only=False).tolist()))
            self.keys = pa.concat_arrays([self.keys, fresh])
        return found

    def keep(self, first: int = 1) -> None:
        stay = self.again.copy()
        stay[:first] = True
        self.keys = self.keys.filter(pa.array(stay))
        self.flat, self.length = self.gather(np.flatnonzero(stay))
        self.start, self.again = np.cumsum(self.length) - self.length, np.zeros(len(self.length), bool)


class ChunkEncoder:
    """A byte-level BPE of the tokenizers library with a memory of what pieces of text encode to.

    Its pre-tokenizer always cuts before a single space that stands between two other characters, around a single line feed and
    before the punctuation that ends a word, so a text without adjacent white space is the sequence of its pieces
    (see cut_pieces). Each distinct piece of a batch is looked up once by Arrow, and the ids are gathered by numpy. A
    new piece that is letters, or letters and then ASCII punctuation, is one or two pre-tokens; those go straight to the library's
    BPE model. Any other new piece, and any text with adjacent white space or the string of an added token,
    goes through the library's whole pipeline.
    """

    _white = r"[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    _made: dict[tuple, ChunkEncoder] = {}

    def __init__(self, path: str, end_id: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([self._white * 2, self._white + "$", *added])
        self.end = [] if end_id is None else [end_id]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE shows these bytes as themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words = PieceRows(self.end)

    def _make_room(self) -> None:
        """Pieces that came again stay, unless they alone fill half of the memory."""
        self.words.keep()
        if len(self.words.length) > CACHE_ENTRIES // 2 or len(self.words.flat) > 4 * CACHE_ENTRIES:
            self.words = PieceRows(self.end)

    @classmethod
    def of(cls, path: str, end_id: int | None = None) -> ChunkEncoder:
        """One for each Python worker."""
        if (path, end_id) not in cls._made:
            cls._made[path, end_id] = cls(path, end_id)
        return cls._made[path, end_id]

    def _pre_token(self, piece: str) -> list[int]:
        if piece.isascii() and piece[1:].isalnum():
            shown = "\u0120" + piece[1:] if piece[0] == " " else piece  # as the table shows a space
        else:
            shown = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(shown)]

    def _piece(self, piece: str) -> list[int]:
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return self._pre_token(piece)
        body = piece.rstrip(string.punctuation)
        if body[1:].isalpha() and (body[0] == " " or body[0].isalpha()) or len(body) == 1 and body.isalpha():
            return self._pre_token(body) + (self._pre_token(piece[len(body) :]) if len(body) < len(piece) else [])
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has), each text's with the end id, if there is one."""
        if len(self.words.length) > CACHE_ENTRIES or len(self.words.flat) > 8 * CACHE_ENTRIES:
            self._make_room()
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, self.odd).to_numpy(zero_copy_only=False)
        counts = np.ones(len(texts), np.int64)  # rows of each text, without its end
        counts[~odd], pieces = cut_pieces(column.filter(pa.array(~odd)))
        coded = pieces.dictionary_encode()
        rows = self.words.of(coded.dictionary, lambda ws: [self._piece(w) for w in ws])
        known = len(self.words.length)
        of_odd = np.repeat(odd, counts)
        inner = np.empty(len(of_odd), np.int64)
        inner[~of_odd] = rows[coded.indices.to_numpy()]
        if odd.any():
            inner[of_odd] = self.words.add([e.ids for e in self.tokenizer.encode_batch([texts[i] for i in np.flatnonzero(odd)], add_special_tokens=False)])
        ends = np.cumsum(counts + 1) - 1
        body = np.ones(len(inner) + len(texts), bool)
        body[ends] = False
        every = np.zeros(len(body), np.int64)
        every[body] = inner
        ids, n = self.words.gather(every)
        self.words.shrink(known)  # whole texts are not remembered
        return ids, np.diff(np.cumsum(n)[ends], prepend=0)


BLOCKS = "part int, block int, tokens long, doc_ids binary, has_id binary, n_tokens binary, codes binary"


def encode_blocks(documents: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """documents(doc_id, text) as blocks of directly addressable codes in ascending doc_id order.

    Ids are integers. Null ids come first, rows of one id in the order of their texts' hashes, repeated rows each
    as a document of its own; a null or empty text has the end id only. Equal keys are dealt over partitions by that
    hash, so no id is too frequent. Each document's ids end with end_id. An empty table has no blocks.
    """
    ordered = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.withColumn("th", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th")
    ordered = ordered.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), F.isnotnull("doc_id").alias("has_id"), "text")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, block = ChunkEncoder.of(path, end_id), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        room = 0

        def close() -> pd.DataFrame:
            nonlocal held, room, block
            ids, has, lengths, tokens = (np.concatenate(x) for x in zip(*held, strict=True))
            row = (part, block, room, ids.astype("<i8").tobytes(), has.astype(np.uint8).tobytes(), lengths.astype("<i8").tobytes(), DirectCodes.encode(tokens).to_bytes())
            held, room, block = [], 0, block + 1
            return pd.DataFrame([row], columns=["part", "block", "tokens", "doc_ids", "has_id", "n_tokens", "codes"])

        for frame in frames:
            texts = frame.text.tolist()
            for a, b in pieces_of(texts, PIECE_BYTES):
                with no_cycles():
                    tokens, lengths = encoder.encode(texts[a:b])
                ends = np.cumsum(lengths)
                has, ids = frame.has_id.to_numpy()[a:b], frame.doc_id.to_numpy()[a:b]
                at = 0
                while at < b - a:
                    begin = ends[at] - lengths[at]
                    to = min(int(np.searchsorted(ends, begin + BLOCK_TOKENS - room)) + 1, b - a)
                    held.append((ids[at:to], has[at:to], lengths[at:to], tokens[begin : ends[to - 1]]))
                    room, at = room + int(ends[to - 1] - begin), to
                    if room >= BLOCK_TOKENS:
                        yield close()
        if held:
            yield close()

    return ordered.mapInPandas(encode, BLOCKS)


def _block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, block_start, tokens): a sum over whole parts (one row for each task that wrote) and over the blocks of a part."""
    sizes = blocks.select("part", "block", "tokens")
    parts = sizes.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = F.sum("tokens").over(Window.partitionBy("part").orderBy("block")) - F.col("tokens")
    return sizes.withColumn("inside", inside).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("inside")).alias("block_start"), "tokens")


def read_documents(blocks: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in stored blocks.

    start counts the ids of all documents before it. Null ids, repeated rows and empty texts come back as they
    were stored; an empty store gives an empty result.
    """
    starts = _block_starts(blocks).drop("tokens")
    schema = "part int, block int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                n = np.frombuffer(row.n_tokens, "<i8")
                ends = np.cumsum(n)
                ids = DirectCodes.from_bytes(row.codes).decode().astype("<u4")
                cut = [ids[e - k : e] for e, k in zip(ends, n, strict=True)]
                doc_ids = pd.array(np.frombuffer(row.doc_ids, "<i8"), "Int64")
                doc_ids[np.frombuffer(row.has_id, np.uint8) == 0] = pd.NA
                out = pd.DataFrame({"doc_id": doc_ids, "start": ends - n, "n_tokens": n, "ids_crc32": [zlib.crc32(c.tobytes()) for c in cut]})
                out.insert(0, "part", row.part)
                out.insert(1, "block", row.block)
                if with_ids:
                    out["ids"] = [c.astype(np.int32) for c in cut]
                yield out

    read = blocks.select("part", "block", "doc_ids", "has_id", "n_tokens", "codes").mapInPandas(decode, schema).join(starts, ["part", "block"])
    return read.select("doc_id", (F.col("block_start") + F.col("start")).alias("start"), *read.columns[4 : 6 + with_ids])


def write_store(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes the blocks of documents (see encode_blocks) as a Parquet table, with Spark's own commit: a lost executor leaves no half files.

    The codes are not compressed again, so that a token's chunks are read from where they stand.
    """
    encode_blocks(documents, tokenizer, end_id).write.parquet(path, compression="none")


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a written store; see read_documents."""
    return read_documents(spark.read.schema(BLOCKS).parquet(path), with_ids)


def tokens_at(spark: SparkSession, path: str, places: list[int]) -> DataFrame:
    """(place, token_id) at global places (0-based, over all documents in order) of a written store.

    The places' blocks are found from the blocks' sizes alone, at most one for each place; their numbers then filter the scan of the codes, so
    that Parquet skips the row groups without them. Each id takes one rank query a level; no block is
    decoded. Repeated places give one row; places outside the store give none. At most 10,000 places a call.
    """
    wanted = sorted(set(places))
    if len(wanted) > 10_000:
        raise ValueError("more than 10,000 places")
    blocks = spark.read.schema(BLOCKS).parquet(path)
    listed = F.array(*[F.lit(p).cast("long") for p in wanted]) if wanted else F.array().cast("array<bigint>")
    inside = F.filter(listed, lambda p: (p >= F.col("block_start")) & (p < F.col("block_start") + F.col("tokens")))
    hit = _block_starts(blocks).withColumn("places", inside).where(F.size("places") > 0).drop("tokens")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                codes = DirectCodes.from_bytes(row.codes)
                yield pd.DataFrame({"place": row.places, "token_id": [codes[int(p) - row.block_start] for p in row.places]})

    found = [tuple(r) for r in hit.select("part", "block", "block_start", "places").collect()]  # no more than places
    few = spark.createDataFrame(found, hit.select("part", "block", "block_start", "places").schema)
    numbers = [sorted({row[i] for row in found}) for i in (0, 1)]
    codes = blocks.where(F.col("part").isin(*numbers[0]) & F.col("block").isin(*numbers[1])).select("part", "block", "codes")
    return codes.join(F.broadcast(few), ["part", "block"]).select("block_start", "places", "codes").mapInPandas(look, "place long, token_id int")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_folder(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_store(spark, folder)
