"""SentencePiece encoding and decoding by forward states shared along a trie of marked words."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nimbora.llm.common import WordRows, let_go, no_cycles, pieces_of, split_words, table

MARK = "▁"
CACHE_ENTRIES = 300_000
SUB_BATCH = 1_000
LONG_WORD = 256
BATCH_CHARACTERS = 1 << 21
#: Texts whose words after single spaces would not be whole units; an empty text has not even the first mark.
ODD = f"^$|^ | $|  |{MARK} "
#: A marked word: its marks and what follows them. No piece has a mark after another character and none has a
#: line feed, so words encode independently of each other.
UNIT = re.compile(rf"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class PieceModel:
    """The pieces of a SentencePiece BPE model with byte fallback, encoded by a forward pass over prefixes.

    A sequence of pieces is the model's encoding exactly when each two neighbours are the encoding of their
    joined text. So every prefix has one feasible last piece, and the forward pass of a Viterbi search over
    scores "feasible or not" gives it from the states of shorter prefixes alone. A word's states hold for all
    words that share the prefix: the distinct words are sorted, which walks their trie depth first, and only
    the states below the last shared prefix are computed.
    """

    _made: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {lib.id_to_piece(i): i for i in plain}
        self.scores = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.longest = max(map(len, self.ids))
        self.bytes = {int(lib.id_to_piece(i)[1:-1], 16): i for i in range(n) if lib.is_byte(i)}
        self.unknown = lib.unk_id()
        self.raw = [b""] * n
        for piece, i in self.ids.items():
            self.raw[i] = piece.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        ends: dict[str, set[int]] = {}  # by its last two characters, how long a piece can be
        for piece in self.ids:
            ends.setdefault(piece[-2:], set()).add(len(piece))
        self.lengths = {c: tuple(sorted(x | {1}, reverse=True)) for c, x in ends.items() if len(c) > 1}
        self.joins: dict[str, dict[str, bool]] = {}  # by the piece before
        self.known = 0
        self.words, self.units, self.column = WordRows(), {}, None

    @classmethod
    def of(cls, path: str) -> PieceModel:
        """One for each Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the best-scored neighbours first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            found = [(-scores[m], i) for i in range(len(parts) - 1) if (m := parts[i] + parts[i + 1]) in scores]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _after(self, piece: str) -> dict[str, bool]:
        """Which pieces are known to fit or not to fit after this one; after the empty one, those that begin a word."""
        got = self.joins.get(piece)
        if got is None:
            got = self.joins[piece] = {}
        return got

    def _fits(self, a: str, b: str) -> bool:
        """Whether b may follow a: together they encode to just these two; a is empty where b begins the word."""
        after = self._after(a)
        got = after.get(b)
        if got is None:
            if self.known > CACHE_ENTRIES:
                self.joins.clear()
                self.known, after = 0, self._after(a)
            self.known += 1
            got = after[sys.intern(b)] = self.merged(a + b) == ([a, b] if a else [b])
        return got

    def piece_ids(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        if i is not None:
            return [i]
        return [self.bytes.get(b, self.unknown) for b in piece.encode("utf-8", "surrogatepass")]

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, walked in sorted order along their trie."""
        out: dict[str, list[int]] = {}
        ids, lengths, one = self.ids, self.lengths, (1,)
        # For the first i characters: their last piece, all their ids, and what fits after the last piece.
        states: list[tuple[str, list[int], dict[str, bool]]] = [("", [], self._after(""))]
        last = ""
        for word in sorted(words):
            if len(word) > LONG_WORD:
                out[word] = self._long_word(word)
                continue
            shared, n = 0, min(len(last), len(word))
            while shared < n and last[shared] == word[shared]:
                shared += 1
            del states[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):  # as _last_piece, without its calls: most time goes here
                for length in lengths.get(word[i - 2 : i], one) if i > 1 else one:
                    j = i - length
                    if j < 0:
                        continue
                    piece = word[j:i]
                    k = ids.get(piece)
                    if k is None and length > 1:
                        continue
                    before, so_far, after = states[j]
                    fits = after.get(piece)
                    if self._fits(before, piece) if fits is None else fits:
                        break
                else:
                    raise ValueError("the model has a prefix without a feasible last piece")
                states.append((piece, [*so_far, k] if k is not None else so_far + self.piece_ids(piece), self._after(piece)))
            out[word] = states[-1][1]
            last = word
        return out

    def _last_piece(self, word: str, i: int, states: list) -> tuple[str, int | None, int]:
        """The last piece of word's first i characters, its id, and where it begins."""
        ids, fits = self.ids, self._fits
        for length in self.lengths.get(word[i - 2 : i], (1,)) if i > 1 else (1,):
            j = i - length
            if j < 0:
                continue
            piece = word[j:i]
            k = ids.get(piece)
            if (k is not None or length == 1) and fits(states[j][0], piece):
                return piece, k, j
        raise ValueError("the model has a prefix without a feasible last piece")

    def _long_word(self, word: str) -> list[int]:
        """The same forward pass, with places to walk back by instead of a list at each place."""
        states: list[tuple[str, int]] = [("", 0)]
        for i in range(1, len(word) + 1):
            piece, _, j = self._last_piece(word, i, states)
            states.append((piece, j))
        cuts, i = [], len(word)
        while i:
            piece, i = states[i]
            cuts.append(self.piece_ids(piece))
        return [k for ids in reversed(cuts) for k in ids]

    def _encode_missing(self, words: list[str]) -> list[list[int]]:
        """Ids of words after a space, which may have line feeds in them."""
        return self._encode_units([UNIT.findall(MARK + w) for w in words])

    def _encode_units(self, units: list[list[str]]) -> list[list[int]]:
        if len(self.units) > CACHE_ENTRIES:
            self.units.clear()
        found, missing = self.units, list({u for us in units for u in us if u not in self.units})
        fresh = self.encode_words(missing)
        several = {u for us in units if len(us) > 1 for u in us}  # words of one unit are remembered as words
        found.update((u, fresh[u]) for u in several if u in fresh and len(u) < LONG_WORD)
        return [list(chain.from_iterable(found[u] if u in found else fresh[u] for u in us)) if len(us) != 1 else found.get(us[0]) or fresh[us[0]] for us in units]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, how many each text has). Arrow finds the distinct words, which are looked up or encoded once."""
        if len(self.words.length) > CACHE_ENTRIES or len(self.words.flat) > 8 * CACHE_ENTRIES:
            self.words = WordRows()
        column = pa.array(texts, pa.string())
        odd = pc.match_substring_regex(column, ODD).to_numpy(zero_copy_only=False)
        offsets, place, words = split_words(column.filter(pa.array(~odd)))
        rows = self.words.of(words, self._encode_missing)[place]
        known = len(self.words.length)
        counts = np.ones(len(texts), np.int64)  # rows of each text
        counts[~odd] = np.diff(offsets)
        if odd.any():
            units = [UNIT.findall((MARK + texts[i].replace(" ", MARK)) if texts[i] else "") for i in np.flatnonzero(odd)]
            of_odd = np.repeat(odd, counts)
            every = np.empty(len(of_odd), np.int64)
            every[~of_odd] = rows
            every[of_odd] = self.words.add(self._encode_units(units))
            rows = every
        ids, n = self.words.gather(rows)
        self.words.shrink(known)
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum(counts)]
        return ids.astype(np.int32), np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
        """The texts of ids that lie one after another; an id that the model doesn't have gives U+FFFD."""
        if self.column is None:
            self.column = pa.array([*self.raw, "\ufffd".encode()], pa.binary())
        ids = np.where((ids < 0) | (ids >= len(self.raw)), len(self.raw), ids)
        pieces = self.column.take(pa.array(ids.astype(np.int32)))
        _, at, data = pieces.buffers()
        at = np.frombuffer(at, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int32)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        ends = at[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int64)
        data = data[: ends[-1]]
        begins = ends[:-1][ends[1:] > ends[:-1]]
        blank = np.zeros(len(lengths), bool)
        blank[ends[1:] > ends[:-1]] = data[begins] == 32  # of the mark that every text begins with
        data = np.delete(data, ends[:-1][blank])
        ends[1:] -= np.cumsum(blank)
        out = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # byte pieces that make no characters
            out = pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)], pa.string())
        return out


def _free(name: str, df: DataFrame) -> str:
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name} already")
    return name


def encode_pieces(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """df plus the piece ids of a text column, as the SentencePiece model at `path` encodes it.

    With `decoded`, a column of that name has the text that the ids give back. Null and empty texts have no
    ids and decode to an empty text; repeated rows get equal ids. Works on each partition by itself, without a
    shuffle; words are remembered up to a fixed number, and texts are taken up a thousand rows at a time. Raises if a new column's name is taken.
    """
    fields = [*df.schema.fields, T.StructField(_free(out, df), T.ArrayType(T.IntegerType(), False))]
    if decoded:
        fields.append(T.StructField(_free(decoded, df), T.StringType()))
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SUB_BATCH):
                batch = whole.slice(at, SUB_BATCH)
                texts = [x or "" for x in batch.column(text).to_pylist()]
                for a, b in pieces_of(texts, BATCH_CHARACTERS):
                    with no_cycles():
                        ids, lengths = model.encode(texts[a:b])
                    new = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))]
                    if decoded:
                        new.append(model.decode(ids, lengths))
                    yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *new], schema.names)
            let_go()

    return df.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df plus the text of a column of piece ids.

    Null and empty ids give an empty text. A null, negative or other id that the model doesn't have gives U+FFFD,
    as do byte pieces that make no character. Raises if the column `out` exists.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(_free(out, df), T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for whole in batches:
            for at in range(0, whole.num_rows, SUB_BATCH):
                batch = whole.slice(at, SUB_BATCH)
                column = batch.column(ids)
                flat = column.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, model.decode(flat, lengths)], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its ids, their number and checksum, and whether decoding gives the text back."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    df = encode_pieces(docs, path, decoded="decoded")
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"),
    )
