"""Byte-level BPE through a sentencepiece model written from the vocabulary.

The model file is serialised here, field by field: each token's bytes become
the characters U+0100 to U+01FF, its score is its negative rank (so the lowest
rank merges first), normalisation is the identity and nothing is added around a
piece. Texts are cut into pre-tokens by the vocabulary's pattern; each distinct
one is encoded once, and decoding is the inverse map from ids to bytes.
"""

import base64
import re
import struct
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import sentencepiece
from pyspark import SparkContext
from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import arrow_udf

#: Distinct pre-tokens that a worker remembers, twice over: the newer ones and the ones before.
REMEMBERED = 200_000
#: Characters of pieces that are encoded in a line.
LINE = 1 << 12
#: Characters that are cut into pre-tokens at a time.
BLOCK = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank a line) in order of rank; ranks run from 0 without gaps."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_piece(token: bytes) -> str:
    """A token as characters: byte b is U+0100 + b."""
    return (np.frombuffer(token, np.uint8).astype("<u2") + 256).tobytes().decode("utf-16-le")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value & (1 << 64) - 1)


def model_bytes(tokens: list[bytes]) -> bytes:
    """The serialised model: the tokens with scores 0, -1, -2, ... as ids 0, 1,
    2, ..., then the unknown piece that a model must have (never produced,
    as every single byte is a token)."""
    if missing := {bytes([b]) for b in range(256)} - set(tokens):
        raise ValueError(f"bytes without a token: {sorted(missing)[:5]}")
    pieces = b"".join(_message(1, _message(1, byte_piece(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -i))
                      for i, t in enumerate(tokens))
    unknown = _message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0) + _number(3, 2))
    # Trainer: BPE, the size, ids of the unknown piece and of none for begin, end and padding.
    trainer = (_number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
               + b"".join(_number(field, -1) for field in (41, 42, 43)))
    # Normaliser: identity, no added prefix, white space left as it is.
    normalizer = _message(1, b"identity") + b"".join(_number(field, 0) for field in (3, 4, 5))
    return pieces + unknown + _message(2, trainer) + _message(3, normalizer)


def byte_pieces(tokens: list[bytes]) -> list[str]:
    """``byte_piece`` of all tokens, mapped in one array."""
    ends = np.cumsum([0, *map(len, tokens)]).tolist()
    mapped = byte_piece(b"".join(tokens))
    return [mapped[lo:hi] for lo, hi in zip(ends, ends[1:])]


def latin_pattern(pattern: str) -> re.Pattern | None:
    """``pattern`` for texts of Latin-1 characters alone, its classes written
    out, which the standard library matches faster; the classes are asked of the
    module that matches all other texts. None if it has escapes other than
    letters, numbers and white space."""
    members = {name: [chr(c) for c in range(256) if regex.match(name, chr(c))] for name in (r"\p{L}", r"\p{N}", r"\s")}
    written = {name: "".join(map(re.escape, found)) for name, found in members.items()}
    out, at, in_class = [], 0, False
    while at < len(pattern):
        name = next((n for n in (*written, r"\S") if pattern.startswith(n, at)), pattern[at])
        if name == "\\" or (name == r"\S" and in_class):
            return None
        if name in written:
            out.append(written[name] if in_class else f"[{written[name]}]")
        elif name == r"\S":
            out.append(f"[^{written[chr(92) + 's']}]")
        else:
            in_class = name == "[" or (in_class and name != "]")
            out.append(name)
        at += len(name)
    return re.compile("".join(out))


class PieceEncoder:
    """Encodes pre-tokens to the bytes of their int32 ids."""

    def __init__(self, model: bytes, tokens: list[bytes], pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern, self.latin = regex.compile(pattern), latin_pattern(pattern)
        self.whole = {t: struct.pack("<i", i) for i, t in enumerate(tokens)}
        self.unknown = len(tokens)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pattern_for(self, text: str):
        if self.latin is None:
            return self.pattern
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern
        return self.latin

    def learn(self, pieces: set[str]) -> None:
        """Make ``pieces`` known. When the memory is full its content becomes
        the older one: what is met again moves back, the rest is forgotten."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        left, tokens = [], []
        for piece in pieces:
            token = piece.encode()
            ids = self.older.get(piece) or self.whole.get(token)
            if ids is None:
                left.append(piece)
                tokens.append(token)
            else:
                self.known[piece] = ids
        if left:
            self.known.update(zip(left, self.encode_pieces(tokens)))

    def encode_pieces(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of many pieces: a line of them at a time, with spaces
        between. A space is in no token, so merges stay within a piece, and each
        space becomes the unknown id, at which the ids are cut again."""
        lines, size, line = [], 0, []
        for piece in byte_pieces(tokens):
            line.append(piece)
            size += len(piece)
            if size > LINE:
                lines.append(" ".join(line))
                line, size = [], 0
        if line:
            lines.append(" ".join(line))
        out = []
        for found in self.processor.encode(lines, num_threads=1):
            ids = np.array(found, "<i4")
            cuts = np.nonzero(ids == self.unknown)[0]
            data = ids.tobytes()
            out += [data[lo:hi] for lo, hi in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(data)])]
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, a block of texts at a time; a text longer than
        a block is cut into blocks of pre-tokens."""
        out, held, size = [], [], 0
        for text in texts:
            if len(text) > BLOCK:
                out += self._flush(held)
                held, size, parts = [], 0, []
                found = self.pattern_for(text).finditer(text)
                while block := [m.group() for m in islice(found, BLOCK // 8)]:
                    parts += self._flush([block])
                out.append(b"".join(parts))
                continue
            held.append(self.pattern_for(text).findall(text))
            size += len(text)
            if size > BLOCK:
                out += self._flush(held)
                held, size = [], 0
        return out + self._flush(held)

    def _flush(self, held: list[list[str]]) -> list[bytes]:
        """Each pre-token is looked up once; those that are new are learned together and put into their places."""
        ids, missing = [], []
        for pretokens in held:
            own = list(map(self.known.get, pretokens))
            at, places = -1, []
            try:
                while True:
                    at = own.index(None, at + 1)
                    places.append(at)
            except ValueError:
                pass
            ids.append(own)
            missing.append(places)
        new = {pretokens[i] for pretokens, places in zip(held, missing) for i in places}
        if new:
            self.learn(new)
            for pretokens, own, places in zip(held, ids, missing):
                for i in places:
                    own[i] = self.known[pretokens[i]]
        return [b"".join(own) for own in ids]


def share_codec(spark: SparkSession, ranks_path: str, pattern: str):
    """Broadcast what encoding and decoding need: a vocabulary, a few MB whatever the data."""
    tokens = read_ranks(ranks_path)
    context: SparkContext = spark.sparkContext
    return context.broadcast({"model": model_bytes(tokens), "tokens": tokens, "pattern": pattern})


def encode(text: Column, codec) -> Column:
    """``array<int>`` of token ids of a text column; a null or empty text has
    no ids. Whole texts are encoded, a block at a time; equal texts have equal
    ids. Bytes that are no UTF-8 are read as U+FFFD."""
    def batch(texts: pa.Array) -> pa.Array:
        state = codec.value
        if "encoder" not in state:
            state["encoder"] = PieceEncoder(state["model"], state["tokens"], state["pattern"])
        parts = state["encoder"].encode([str(t or b"", "utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()])
        offsets = np.cumsum([0, *map(len, parts)]) // 4
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4")))
    return arrow_udf(batch, "array<int>")(text)


def decode(ids: Column, codec) -> Column:
    """``binary`` of a column of token ids; null counts as empty, an unknown id raises."""
    def batch(lists: pa.Array) -> pa.Array:
        state = codec.value
        if "pieces" not in state:
            state["pieces"] = pa.array(state["tokens"], pa.binary())
        lists = lists.fill_null([]) if lists.null_count else lists
        data = state["pieces"].take(lists.flatten())
        bounds = np.frombuffer(data.buffers()[1], "<i4", len(data) + 1, data.offset * 4)
        ends = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))])
        return pa.BinaryArray.from_buffers(pa.binary(), len(lists),
                                           [None, pa.py_buffer(bounds[ends].astype("<i4").tobytes()), data.buffers()[2]])
    return arrow_udf(batch, "binary")(ids)
