"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton of the pieces, and decoding."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Memo, kept, slices

#: The sign that stands for a space, and the runs that a best path can be cut into where no piece has it after another character.
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Distinct runs that a worker remembers, in each of two generations, at some 250 bytes each.
MOST_RUNS = 120_000


class PieceCoder:
    """Encodes by the model's piece scores: the path with the highest sum; of equal sums, that with the longest last piece.

    Normalisation is the identity with a leading space sign, as the model has it; characters without a
    piece become their UTF-8 bytes' pieces. Each run of text between spaces is decoded on its own (no
    piece spans a space after other text, which the constructor checks), so that equal runs are looked up.
    """

    def __init__(self, proto: bytes):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.automaton = ahocorasick.Automaton()
        self.bytes, self.table, least, self.whole = {}, [], 0.0, False
        for i in range(model.get_piece_size()):
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.table.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.table.append(b"")
            else:
                self.table.append(piece.replace(SPACE, " ").encode())
                self.automaton.add_word(piece, (len(piece), score, i))
                least = min(least, score)
                self.whole |= SPACE in piece.lstrip(SPACE)
        self.automaton.make_automaton()
        self.unknown = least - 10.0
        self.memo = Memo(self._run, MOST_RUNS)

    def ids(self, run: str) -> list[int]:
        """The best path over one run: at each end the automaton's output links give every piece that ends there, longest first."""
        n = len(run)
        best, back, pieces = [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        matches = self.automaton.iter(run)
        match = next(matches, None)
        for end in range(1, n + 1):
            top, start, piece, single = -np.inf, end - 1, -1, False
            while match is not None and match[0] == end - 1:
                length, score, i = match[1]
                sum_ = best[end - length] + score
                single |= length == 1
                if sum_ > top:
                    top, start, piece = sum_, end - length, i
                match = next(matches, None)
            if not single and best[end - 1] + self.unknown > top:
                top, start, piece = best[end - 1] + self.unknown, end - 1, -1
            best[end], back[end], pieces[end] = top, start, piece
        out, at = [], n
        while at:
            i = pieces[at]
            out.extend([i] if i >= 0 else [self.bytes[b] for b in reversed(run[at - 1].encode("utf-8", "replace"))])
            at = back[at]
        return out[::-1]

    def _run(self, run: str) -> bytes:
        return np.array(self.ids(run), "<i4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        marked = SPACE + text.replace(" ", SPACE)
        runs = [marked] if self.whole else _RUNS.findall(marked)
        return np.frombuffer(b"".join(map(self.memo.__getitem__, runs)), "<i4")

    def decode(self, ids) -> str:
        text = b"".join(map(self.table.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def model_proto(path: str | None = None) -> bytes:
    """The model file's bytes, read on the driver; path defaults to the public 32k model's."""
    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def _coder(proto: bytes) -> PieceCoder:
    return kept(("pieces", hash(proto)), lambda: PieceCoder(proto))


def _pieces(docs: DataFrame, model_path: str | None, row, schema: str, arrow: list[pa.DataType]) -> DataFrame:
    """doc_id and what row(coder, text) gives of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model_proto(model_path))  # a model file: under 1 MB
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in slices(batches, 1, 4 << 20):
            columns = list(zip(*(row(coder, x.as_py()) for x in batch.column(1)), strict=True)) or [[]] * len(arrow)
            made = [_lists(c) if t == pa.list_(pa.int32()) else pa.array(c, t) for c, t in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {schema}")


def _lists(rows) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if len(rows) else np.empty(0, np.int32)))


def encode_docs(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of every row of docs (doc_id, text); null and empty texts have no ids, repeated rows
    equal ones, other columns are left out, and an empty table gives no rows."""

    def row(coder: PieceCoder, text: str | None):
        ids = coder.encode(text)
        return len(ids), ids

    return _pieces(docs, model_path, row, "n_tokens long, ids array<int>", [pa.int64(), pa.list_(pa.int32())])


def encode_digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256 and round_trip of every row of docs (doc_id, text), as encode_docs and decode_docs
    have them: one pass, so that ids needn't be stored to be checked."""

    def row(coder: PieceCoder, text: str | None):
        ids = coder.encode(text)
        back = coder.decode(ids)
        return len(ids), zlib.crc32(ids.tobytes()), hashlib.sha256(back.encode("utf-8", "replace")).hexdigest(), back == (text or "").replace(SPACE, " ")

    return _pieces(docs, model_path, row, "n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean", [pa.int64(), pa.int64(), pa.string(), pa.bool_()])


def decode_docs(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id and text of every row of encoded (doc_id, ids): the texts that encode_docs had, a literal U+2581 as a space."""
    shared = encoded.sparkSession.sparkContext.broadcast(model_proto(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value)
        for batch in batches:
            out = [coder.decode(x.values.to_numpy() if x.is_valid else []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Every text encoded and its ids decoded, as digests of both."""
    return encode_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
