"""Token ids in files of range-coded blocks: encoding texts, writing in doc_id order, reading back."""

from __future__ import annotations

import codecs
import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulsegrid.llm.common import Memo, kept, shared_dir, slices
from pulsegrid.llm.rangecoder import MOST_ID, Tables, decode_blocks, encode_blocks

#: The id that ends a document, and how ids are held before they are coded.
END, IDS = 2, "<u2"
MAGIC = b"PGTOKEN4"
#: Classes of characters, by which the byte-level model cuts text before it merges: a space, other white space, a letter, a number, a sign.
_SPACE, _WHITE, _LETTER, _NUMBER, _SIGN = range(5)
_BLANK, _LINE = b" \n"
#: Ids of a file, about: what a task holds before it writes.
FILE_TOKENS = 8_000_000
#: Distinct cuts that a worker remembers, in each of two generations, at some 200 bytes each.
MOST_WORDS = 500_000
#: Bytes of texts whose cuts are looked up at once, and new cuts that the model gets at once.
AT_ONCE, TOGETHER = 8 << 20, 500


def byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(others)}


def classes() -> np.ndarray:
    """The class of each code point."""
    every, out = np.delete(np.arange(0x110000), slice(0xD800, 0xE000)).astype("<u4").tobytes().decode("utf-32-le"), np.full(0x110000, _SIGN, np.uint8)
    for found in regex.finditer(r"(\s+)|(\p{L}+)|(\p{N}+)", every):
        out[ord(every[found.start()]) : ord(every[found.end() - 1]) + 1] = found.lastindex
    out[ord(" ")] = _SPACE
    return out


class TextCoder:
    """ids of texts, as the tokenizers library has them; the library's model merges each distinct cut once.

    Before it merges, the byte-level model cuts a text by

        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    and merges never cross a cut. Where a cut begins follows from the classes of two or three characters beside each other.
    """

    def __init__(self, tokenizer: str):
        self.library, letters = Tokenizer.from_str(tokenizer), byte_letters()
        self.model, self.letters = self.library.model, "".join(chr(letters[b]) for b in range(256))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.classes, self.words, self.older = classes(), {}, {}
        self.ascii = bytes([*self.classes[:128].tolist(), *[_SIGN] * 128])
        known, byte = json.loads(tokenizer)["model"], {chr(c): b for b, c in letters.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in known["merges"]]
        # of a space and a line end: the ids that begin with it, the bytes that it may merge with before it, and after it
        self.begins, self.before, self.after = {}, {}, {}
        for sign in (_BLANK, _LINE):
            letter, self.begins[sign] = self.letters[sign], np.zeros(1 << 16, bool)
            self.begins[sign][[i for w, i in known["vocab"].items() if w[:1] == letter]] = True
            self.before[sign] = {byte.get(a[-1:]) for a, b in merges if b[:1] == letter}
            self.after[sign] = {byte.get(b[:1]) for a, b in merges if a[-1:] == letter}
        # a model that may take a whole cut otherwise than by its merges gets cuts one by one
        self.apart = not any(known.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix"))

    def _merged(self, cut: bytes) -> np.ndarray:
        return np.array([t.id for t in self.model.tokenize(codecs.charmap_decode(cut, "strict", self.letters)[0])], IDS)

    def _together(self, cuts: list[bytes], sign: int) -> list[bytes]:
        """The ids of cuts that all begin with a space, or that have a line end put before them, which merge with nothing beside them."""
        line = sign == _LINE
        ids = self._merged(b"\n" * line + (b"\n" if line else b"").join(cuts))
        first = np.flatnonzero(self.begins[sign][ids])
        if first.size != len(cuts):
            return [self._merged(c).tobytes() for c in cuts]
        packed, first = ids.tobytes(), (2 * first).tolist()
        return [packed[s + 2 * line : e] for s, e in itertools.pairwise([*first, 2 * ids.size])]

    def _look_up(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of each; those of up to Memo.LONGEST bytes are remembered, in two generations."""
        found = list(map(self.words.get, cuts))
        missing = [i for i, u in enumerate(found) if u is None]
        spaced, others, older = [], [], self.older.get
        for i in missing:
            c = cuts[i]
            found[i] = u = older(c)
            if u is None:
                if not self.apart or c.isspace():
                    found[i] = self._merged(c).tobytes()
                elif c[0] == _BLANK and c[-1] not in self.before[_BLANK]:
                    spaced.append(i)
                elif c[0] not in self.after[_LINE] and c[-1] not in self.before[_LINE]:
                    others.append(i)
                else:
                    found[i] = self._merged(c).tobytes()
        for sign, rows in ((_BLANK, spaced), (_LINE, others)):
            for k in range(0, len(rows), TOGETHER):
                part = rows[k : k + TOGETHER]
                for i, ids in zip(part, self._together([cuts[i] for i in part], sign), strict=True):
                    found[i] = ids
        if len(self.words) + len(missing) > MOST_WORDS:
            self.words, self.older = {}, self.words
        self.words.update((cuts[i], found[i]) for i in missing if len(cuts[i]) <= Memo.LONGEST)
        return found

    def _starts(self, data: bytes, bounds: np.ndarray) -> np.ndarray:
        """Where cuts begin in UTF-8 texts that stand one after another; bounds: of the texts, with the end."""
        data += bytes(4)
        text, kinds = np.frombuffer(data, np.uint8), np.frombuffer(bytearray(data.translate(self.ascii)), np.uint8)
        leads = np.flatnonzero(text >= 0xC0)
        size = 2 + (text[leads] >= 0xE0) + (text[leads] >= 0xF0)
        wide = []
        for n in (2, 3, 4):
            at = leads[size == n]
            point = text[at].astype(np.int32) & ((1 << 7 - n) - 1)
            for k in range(1, n):
                point = point << 6 | text[at + k] & 0x3F
            kind = np.take(self.classes, point, mode="clip")
            for k in range(n):
                kinds[at + k] = kind
            wide += [(n, at[kind == _WHITE])]
        starts = np.zeros(text.size, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts[1:] &= kinds[:-1] != _SPACE

        def last(at: np.ndarray) -> np.ndarray:
            """Whether what comes before `at` is a text's last, or has white space after it."""
            return (kinds[at] <= _WHITE) | (bounds[np.searchsorted(bounds, at)] == at)

        # of white space in a row before something else, the last one is its own
        white = kinds <= _WHITE
        at = np.flatnonzero(white[1 : bounds[-1]] & white[: bounds[-1] - 1]) + 1
        starts[at] = ~last(at + 1)
        for n, at in wide:
            starts[at] = (kinds[at - 1] > _WHITE) | ~last(at + n)
            for k in range(1, n):
                starts[at + k] = False
        starts[bounds] = True
        at = np.flatnonzero(text == ord("'"))
        at = at[starts[at]]
        one, two = text[at + 1], text[at + 2]
        size = 2 * np.isin(one, list(b"stmd")) + 3 * (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        keeps = (size > 0) & (at + size <= bounds[np.searchsorted(bounds, at, side="right")])
        starts[at[keeps] + 1] = False
        starts[(at + size)[keeps]] = True
        return np.flatnonzero(starts[: bounds[-1]])

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([None if text is None else text.encode("utf-8", "replace").decode()], pa.string()))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Packed IDS of each text; null is empty. A text with the string of a special token goes to the library whole."""
        out = [b""] * len(texts)
        special = pa.array(np.zeros(len(texts), bool))
        for s in self.special:
            special = pc.or_(special, pc.fill_null(pc.match_substring(texts, s), False))
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.library.encode(texts[i].as_py(), add_special_tokens=False).ids, IDS).tobytes()
        rows = np.flatnonzero(pc.and_(pc.invert(special), pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)))
        if not rows.size:
            return out
        _, bounds, data = texts.take(pa.array(rows)).cast(pa.large_string()).buffers()
        bounds = np.frombuffer(bounds, "<i8", rows.size + 1)
        starts = self._starts(data.to_pybytes()[: bounds[-1]], bounds)
        cuts = pa.Array.from_buffers(pa.large_binary(), starts.size, [None, pa.py_buffer(np.append(starts, bounds[-1])), data]).dictionary_encode()
        distinct = cuts.dictionary.to_numpy(zero_copy_only=False).tolist()
        units = [u for k in range(0, len(distinct), MOST_WORDS // 5) for u in self._look_up(distinct[k : k + MOST_WORDS // 5])]
        _, ends, ids = pa.array(units, pa.large_binary()).take(cuts.indices).buffers()
        ids, ends = ids.to_pybytes(), np.frombuffer(ends, "<i8")[np.searchsorted(starts, bounds)].tolist()
        for i, (s, e) in zip(rows.tolist(), itertools.pairwise(ends), strict=True):
            out[i] = ids[s:e]
        return out


def pack(doc_ids: pa.Array, docs: list[bytes]) -> bytes:
    """A file: magic; documents, ids, blocks, bytes of the next two (u64 each); zstandard of doc_ids, null flags and lengths, and of
    the tables of frequencies; a row (tokens, bytes, crc32) for each block; the blocks, each of which can be read with the tables alone."""
    sizes = np.array([len(d) // 2 for d in docs], "<u8")
    ids = np.frombuffer(b"".join(docs), IDS)
    tables, blocks = encode_blocks(ids)
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    keys = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False).astype("<i8")
    head, table = (zstandard.ZstdCompressor(level=3).compress(x) for x in (keys.tobytes() + known.tobytes() + sizes.tobytes(), tables.to_bytes()))
    rows = np.array([(n, len(b), crc) for n, crc, b in blocks], "<u4").reshape(-1, 3)
    return b"".join([MAGIC, struct.pack("<5Q", len(docs), ids.size, len(blocks), len(head), len(table)), head, table, rows.tobytes(), *[b for _, _, b in blocks]])


def unpack(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(doc_ids, lengths, ids) of a file; ValueError where it isn't one, is cut short, or a checksum doesn't hold."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, total, blocks, head, table = struct.unpack_from("<5Q", data, 8)
    raw = zstandard.ZstdDecompressor().decompress(data[48 : 48 + head]) if docs else b""
    keys, known, sizes = np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, np.uint8, docs, 8 * docs), np.frombuffer(raw, "<u8", docs, 9 * docs)
    at = 48 + head
    tables = Tables.from_bytes(zstandard.ZstdDecompressor().decompress(data[at : at + table]))
    at += table
    rows = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(-1, 3)
    at += 12 * blocks
    parts = []
    for n, size, crc in rows.tolist():
        if at + size > len(data):
            raise ValueError("a token file that is cut short")
        parts.append((n, crc, data[at : at + size]))
        at += size
    ids = decode_blocks(tables, parts)
    if ids.size != total or int(sizes.sum()) != total:
        raise ValueError("a token file whose lengths don't add up")
    return pa.array(keys, mask=known == 0), sizes.astype(np.int64), ids


def _name(part: int, number: int) -> str:
    return f"tokens-{part:06d}-{number:04d}.pgt"


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str | None = None, files: int | None = None) -> list[tuple[str, int, int]]:
    """Writes the ids of docs (doc_id, text), END after each document, to files in folder; (path, documents, ids) of each, in order.

    Documents stand in ascending doc_id order within and across files (null ids first, equal ids by a
    hash of their texts). A file is written under a name of the task's attempt and then renamed, so that
    a lost or repeated task leaves the same file. The driver gets a row for each file.
    """
    spark = docs.sparkSession
    with open(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a tokenizer file: 1.6 MB
    if Tokenizer.from_str(shared.value).get_vocab_size() > MOST_ID:
        raise ValueError(f"a tokenizer of more than {MOST_ID} ids")
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    dealt = keyed.repartitionByRange(files, "doc_id", "th").sortWithinPartitions("doc_id", "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = kept(("text", hash(shared.value)), lambda: TextCoder(shared.value)), np.array([END], IDS).tobytes()
        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(folder)
        keys, rows, held, number = [], [], 0, 0

        def write() -> pa.RecordBatch:
            fs.create_dir(root, recursive=True)
            path, part = f"{root}/{_name(context.partitionId(), number)}", f"{root}/.attempt-{context.taskAttemptId()}-{number}"
            with fs.open_output_stream(part) as f:
                f.write(pack(pa.concat_arrays(keys), rows))
            fs.move(part, path)
            return pa.RecordBatch.from_pydict({"part": [context.partitionId()], "number": [number], "docs": [len(rows)], "tokens": [held]})

        for batch in slices(batches, 2, AT_ONCE):
            for i, x in enumerate(coder.encode_all(batch.column(2))):
                keys.append(batch.column(0).slice(i, 1))
                rows.append(x + end)
                held += len(rows[-1]) // 2
                if held >= FILE_TOKENS:
                    yield write()
                    keys, rows, held, number = [], [], 0, number + 1
        if rows:
            yield write()

    made = dealt.select("doc_id", "th", "text").mapInArrow(run, "part long, number long, docs long, tokens long").collect()
    return [(f"{folder}/{_name(r['part'], r['number'])}", r["docs"], r["tokens"]) for r in sorted(made)]


def read_tokens(spark, manifest: list[tuple[str, int, int]], ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids of the files of write_tokens."""
    rows, start = [], 0
    for path, _, tokens in manifest:
        rows.append((path, start))
        start += tokens
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at) as f:
                    keys, sizes, all_ids = unpack(f.read())
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(all_ids).cast("B") if all_ids.size else b""
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [keys, pa.array(first + starts), pa.array(sizes), pa.array(crc, pa.int64())]
                if ids:
                    offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(all_ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    table = spark.createDataFrame(rows, "path string, first long").repartition(max(1, len(rows)))
    return table.mapInArrow(run, schema)


def op8_token_binary(spark, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    manifest = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_tokens(spark, manifest, ids=False)
