"""SentencePiece encoding and decoding.

Encoding finds the best-scoring segmentation into pieces.  An Aho-Corasick automaton over the
pieces reads each position once; the pieces that end there, found along its output links, relax
the best score of the position (Viterbi in a single pass).  A character without a piece of its
own costs less than the worst piece and falls back to its bytes.  The scores are those of the
given model file, whatever it was trained with, under the unigram reading of a piece's score.

No piece has a space mark behind another character, so a text falls into independent chunks at
its spaces; chunks that were met before are looked up (a bounded table in each worker).
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, slices, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO = 200_000
DECODE_ROWS = 500
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6


def _fields(buf: bytes):
    """(number, value) of the top-level fields of a protocol buffer message."""
    i = 0

    def varint():
        nonlocal i
        x = shift = 0
        while True:
            b = buf[i]
            i += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while i < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, buf[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, buf[i : i + n]
            i += n


class PieceCodec:
    """Encoder and decoder of one model file (identity normaliser, dummy prefix, byte fallback)."""

    def __init__(self, model: bytes):
        self.pieces, self.scores, kinds = [], [], []
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, _NORMAL))
        self.automaton = ahocorasick.Automaton()
        self.byte_id = {}
        self.unknown = 0
        worst = 0.0
        table = []
        for i, (piece, score, kind) in enumerate(zip(self.pieces, self.scores, kinds)):
            out = b""
            if kind == _NORMAL:
                self.automaton.add_word(piece, (len(piece), i, score))
                worst = min(worst, score)
                out = piece.replace(SPACE, " ").encode()
            elif kind == _BYTE:
                self.byte_id[int(piece[3:5], 16)] = i
                out = bytes([int(piece[3:5], 16)])
            elif kind == _UNKNOWN:
                self.unknown = i
                out = " ⁇ ".encode()
            table.append(out)
        self.automaton.make_automaton()
        self.unknown_score = worst - UNKNOWN_PENALTY
        self.splits = not any(SPACE in p.lstrip(SPACE) for p, k in zip(self.pieces, kinds) if k == _NORMAL)
        self.out_len = np.array([len(t) for t in table], np.int64)
        self.out_at = np.r_[0, np.cumsum(self.out_len)[:-1]]
        self.out = np.frombuffer(b"".join(table), np.uint8)
        self.memo: dict[str, bytes] = {}

    def best(self, s: str) -> list[int]:
        """The piece ids of the best segmentation of ``s`` (spaces already marked); ties go to the longer last piece."""
        n = len(s)
        score, back = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        at = 0  # positions up to here are final
        single = False

        def close(end):  # unknown characters: those that no single piece covers
            nonlocal at, single
            while at < end:
                at += 1
                if not single and score[at - 1] + self.unknown_score > score[at]:
                    score[at], back[at] = score[at - 1] + self.unknown_score, (1, -1)
                single = False

        for last, (k, i, piece_score) in self.automaton.iter(s):
            end = last + 1
            close(last)
            value = score[end - k] + piece_score
            if value > score[end]:
                score[end], back[end] = value, (k, i)
            single = single or k == 1
        close(n)
        out = []
        while n:
            k, i = back[n]
            if i >= 0:
                out.append(i)
            else:
                out.extend([self.byte_id[b] for b in reversed(s[n - 1].encode("utf-8", "surrogatepass"))] if self.byte_id else [self.unknown])
            n -= k
        return out[::-1]

    def _chunk(self, s: str) -> bytes:
        got = np.array(self.best(s), np.int32).tobytes()
        if len(s) <= 64:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[s] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text; an empty text has none."""
        if not text:
            return np.zeros(0, np.int32)
        if not self.splits:
            return np.array(self.best(SPACE + text.replace(" ", SPACE)), np.int32)
        memo, chunk = self.memo, self._chunk
        if text[0] in (" ", SPACE) or "  " in text or SPACE in text:
            parts = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        else:
            parts = (SPACE + text.replace(" ", " " + SPACE)).split(" ")
        return np.frombuffer(b"".join([memo.get(p) or chunk(p) for p in parts]), np.int32)

    def decode_many(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each run of ids; the dummy prefix goes.  Ids outside the vocabulary are an error."""
        lens = self.out_len[ids]
        total = np.r_[0, np.cumsum(lens)]
        flat = self.out[np.repeat(self.out_at[ids] - total[:-1], lens) + np.arange(total[-1])] if len(ids) else self.out[:0]
        cut = total[np.r_[0, np.cumsum(sizes)]]
        out = []
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            x = flat[a:b].tobytes()
            out.append(x[1:] if x[:1] == b" " else x)
        return out


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """The codec of a model file, read once in each worker."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = PieceCodec(f.read())
    return _codecs[path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, ids)`` for every row; a null text counts as empty, and an empty text has no ids.

    ``model`` is the path of a model file that every worker has.
    """

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in slices(batch, most=2 << 20):
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), list_array(ids, np.int32)], ["doc_id", "text", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, text string, ids array<int>")


def decode(encoded: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` plus ``decoded``: the text of its ids (null ids: empty).  Bytes that are no UTF-8 become U+FFFD."""
    names = encoded.columns
    at_col = names.index(ids_col)

    def run(batches):
        c = codec(model)
        for batch in batches:
            for at in range(0, batch.num_rows, DECODE_ROWS):
                part = batch.slice(at, DECODE_ROWS)
                lists = part.column(at_col)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out = [x.decode("utf-8", "replace") for x in c.decode_many(lists.flatten().to_numpy(), sizes)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], [*names, "decoded"])

    from pyspark.sql.types import StringType, StructField, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def pieces_of(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_pieces, ids, decoded_sha256, round_trip)`` for every row: encoded, then decoded from the ids, in one pass.

    ``round_trip`` tells whether the decoded text is the text; it is false only where the text holds the space mark itself.
    """
    model = model or default_model()

    def run(batches):
        c = codec(model)
        for batch in batches:
            for part in slices(batch, most=1 << 20):
                texts = part.column(1).to_pylist()
                ids = [c.encode(t) for t in texts]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                out = c.decode_many(flat, sizes)
                same = [x == t.encode("utf-8", "surrogatepass") for x, t in zip(out, texts)]
                cols = [part.column(0), pa.array(sizes), list_array(ids, np.int32), pa.array([hashlib.sha256(x).hexdigest() for x in out]), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def op2_sentencepiece(spark, sf_dir):
    return pieces_of(table(spark, sf_dir, "documents"))
