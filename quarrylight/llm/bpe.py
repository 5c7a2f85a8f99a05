"""Byte-level BPE encoding and decoding with an Aho-Corasick automaton.

Bytes are mapped to Latin-1 characters, so that ``pyahocorasick`` can hold the vocabulary.
A piece of text is encoded by taking the longest token at each position and stepping back
to a shorter one where two adjacent tokens can't stand beside each other in the output of
the merge procedure.  A sequence of tokens is that output exactly when each adjacent pair
is, so pairs are all that has to be checked; their answers are memoised.  Each position is
given up at most once, hence linear time, however long the piece is.

Null texts count as empty, and empty texts have no tokens.  Rows with equal ids are encoded
one by one; columns other than id and text are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import memo, small_batches, tidy

#: Entries after which a memo is emptied; a bound on memory, never on results.
MEMO_ENTRIES = 250_000

_codecs: dict[str, Codec] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: The usual byte-level pattern, a fixed value.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _class(pattern: str, last: int) -> str:
    """The inside of a character class with the code points, up to the last, that a pattern matches in the library.

    The library's own tables are asked, with a vocabulary of single bytes: what the pattern
    doesn't match, its output lacks.
    """
    single = tiktoken.Encoding("single", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    every = "".join(chr(i) for i in range(last + 1) if not 0xD800 <= i < 0xE000)
    held = set(bytes(single.encode_ordinary(every)).decode("utf-8"))
    parts, start = [], None
    for i in range(last + 2):
        inside = i <= last and chr(i) in held
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            parts.append(re.escape(chr(start)) + ("-" + re.escape(chr(i - 1)) if i - 1 > start else ""))
            start = None
    return "".join(parts)


def _usual(last: int) -> re.Pattern[str]:
    letter, number, space = _class(r"\p{L}", last), _class(r"\p{N}", last), _class(r"\s", last)
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """Splits text by a pattern; the usual byte-level pattern has a form that is faster.

    ``re`` with explicit classes is several times faster than property lookups.  The fast
    form tells letters, numbers and spaces by the tables of the ``tiktoken`` library; texts
    with characters beyond U+FFFF take classes that go on beyond.
    """

    def __init__(self, pattern: str) -> None:
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.fast = self.far = None
        if pattern == USUAL:
            self.fast = _usual(0xFFFF)
        else:
            self.whole = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))

    def __call__(self, text: str) -> list[str]:
        if self.fast is None:
            return self.whole.findall(text)
        if not self.beyond.search(text):
            return self.fast.findall(text)
        if self.far is None:
            self.far = _usual(0x10FFFF)
        return self.far.findall(text)


class Codec:
    """Encoder and decoder for one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = Splitter(pattern)
        self.token = {rank: token for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = memo({})
        self.pieces: dict[str, tuple[int, ...]] = memo({})
        self.automaton = ahocorasick.Automaton()
        #: The two tokens of each token's last merge.
        self.halves: dict[int, tuple[int, int]] = {}
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self.merged(token, rank)
                if len(parts) != 2:
                    continue  # merging never produces it, so it is no part of an output
                self.halves[rank] = ranks[parts[0]], ranks[parts[1]]
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.length = {rank: len(token) for token, rank in ranks.items()}
        #: For each token the longest one that is a proper beginning of it, or -1.
        self.shorter: dict[int, int] = {}
        for token, rank in ranks.items():
            heads = (ranks.get(token[:i]) for i in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in heads if r is not None and (self.length[r] == 1 or r in self.halves)), -1)

    def merged(self, word: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merge procedure itself, up to a rank: lowest rank first, leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [self.ranks.get(parts[i] + parts[i + 1], below) for i in range(len(parts) - 1)]
            lowest = min(ranked)
            if lowest >= below:
                break
            best = ranked.index(lowest)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side in an output.

        Only a merge across their boundary can prevent it.  What lies at the boundary over
        time are the right edges of the left token's merge tree and the left edges of the
        right one's, so the trees are taken apart from the last merge backwards (of equal
        ranks the right one came last), and each pair of edges that stood beside each other
        is looked up: a merge of them that comes before the next step prevents the two.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) >= MEMO_ENTRIES:
            self.pairs.clear()
        halves, token, ranks = self.halves, self.token, self.ranks
        x, y, next_step, known = left, right, 1 << 60, True
        while True:
            across = ranks.get(token[x] + token[y])
            if across is not None and across < next_step:
                known = False
                break
            apart_x, apart_y = halves.get(x), halves.get(y)
            if apart_x is None and apart_y is None:
                break
            if apart_y is None or (apart_x is not None and x > y):
                next_step, x = x, apart_x[1]  # at equal ranks the merge further left goes first
            else:
                next_step, y = y + 1, apart_y[0]
        self.pairs[left, right] = known
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """Tokens of one piece, by longest matches and stepping back."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        size, pairs, length, shorter = len(word), self.pairs, self.length, self.shorter
        longest = [-1] * size
        for end, rank in self.automaton.iter(word.decode("latin-1")):
            longest[end + 1 - length[rank]] = rank  # of those that start here, longer ones come later
        taken: list[int] = []
        ends = [0]
        closed = bytearray(size + 1)
        at, before, rank = 0, -1, longest[0]
        while at < size:
            while rank >= 0:
                after = at + length[rank]
                if not closed[after]:
                    if before < 0:
                        break
                    fits = pairs.get((before, rank))
                    if fits if fits is not None else self.compatible(before, rank):
                        break
                rank = shorter[rank]
            if rank >= 0:
                taken.append(rank)
                ends.append(after)
                at, before, rank = after, rank, longest[after] if after < size else -1
            elif not taken:
                raise ValueError("the vocabulary has no token for some byte")
            else:
                # nothing can follow here, whatever came before: the position is closed for good
                closed[ends.pop()] = 1
                rank = shorter[taken.pop()]
                at, before = ends[-1], taken[-1] if taken else -1
        return taken

    def encode(self, text: str) -> list[int]:
        pieces = self.pieces
        ids: list[int] = []
        for piece in self.split(text):
            known = pieces.get(piece)
            if known is None:
                known = self._remember(piece)
            ids += known
        return ids

    def _remember(self, piece: str) -> tuple[int, ...]:
        if len(self.pieces) >= MEMO_ENTRIES:
            self.pieces.clear()
        known = tuple(self.encode_word(piece.encode("utf-8")))
        if len(piece) <= 64:
            self.pieces[piece] = known
        return known

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def codec(ranks: dict[bytes, int], pattern: str, key: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    if key not in _codecs:
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _shared_codec(spark, vocab_path: str, pattern: str):
    """A function that gives a worker its codec; the file is read on the driver only.

    The broadcast is the vocabulary file, whose size is fixed.
    """
    small_batches(spark)
    with open(vocab_path, "rb") as file:
        raw = file.read()
    held = spark.sparkContext.broadcast(raw)
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()

    def get() -> Codec:
        if key not in _codecs:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, held.value.splitlines())}
            return codec(ranks, pattern, key)
        return _codecs[key]

    return get


def encode(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (array of int) of every whole text; null and empty texts have none."""
    get = _shared_codec(docs.sparkSession, vocab_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            ids = [own.encode(text.as_py() or "") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``bytes``: the bytes of a list of ids; null lists give no bytes."""
    get = _shared_codec(encoded.sparkSession, vocab_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            out = [own.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    narrow = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, bytes binary").withColumnRenamed("id", id_col)


def tokenised(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids and decoded_sha256 for each row: the tokens, and the digest of what they decode to."""
    get = _shared_codec(docs.sparkSession, vocab_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            for start in range(0, batch.num_rows, 200):  # ids take more room than texts
                part = batch.slice(start, 200)
                ids = [own.encode(text.as_py() or "") for text in part.column(1)]
                sums = [hashlib.sha256(own.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(sums)], names=["id", "n_tokens", "ids", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids array<int>, decoded_sha256 string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, vocab_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes each whole text, decodes the ids again and returns the digests of both.

    ``id_col``, ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids joined by commas) and
    ``decoded_sha256`` (of the decoded bytes); null texts count as empty.  One pass, no
    shuffle; ids don't leave the worker.
    """
    get = _shared_codec(docs.sparkSession, vocab_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        decimal = {rank: b"%d" % rank for rank in own.token}.__getitem__
        for batch in batches:
            counts, id_sums, byte_sums = [], [], []
            for text in batch.column(1):
                ids = own.encode(text.as_py() or "")
                counts.append(len(ids))
                id_sums.append(hashlib.sha256(b",".join(map(decimal, ids))).hexdigest())
                byte_sums.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_sums), pa.array(byte_sums)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(tidy(run), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
