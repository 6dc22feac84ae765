"""Token sequences as Arrow IPC files of fixed-size lists.

The documents in id order are one stream of token ids. Every file holds a stretch of it as rows of ``length`` ids
and as many mask bits; only a file's last row is padded. Rows are equally long, so row i of a batch is a slice of
one buffer: a memory-mapped file gives any sequence without copying (``read_sequence``). A second Arrow file beside
it says where each document starts.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from petrichor.llm.common import shared_folder, written
from petrichor.llm.files import make_folder, open_at

LENGTH = 2048
#: Rows of one record batch: 2 MB of ids.
BATCH_ROWS = 512
MANIFEST = "part int, file string, index_file string, documents bigint, tokens bigint"
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


#: Places where a text may be cut without changing its ids, and the marked replacement.
BOUNDARIES = [
    (r" ([\p{L}\p{N}])", "\x00 \\1"),
    (r"([\p{L}\p{N}])([,.;:!?|])", "\\1\x00\\2"),
    (r"([\p{L}\p{N}\p{P}])\n([\p{L}\p{N}])", "\\1\n\x00\\2"),
]


class Encoder:
    """Token ids of texts, word by word.

    The splitting rule of this byte-level BPE always starts a new piece at a space that a letter or digit
    follows, at a punctuation mark (no apostrophe) right after a letter or digit, and at a letter or digit after
    one line break. So a text is the concatenation of the chunks between such places, equal chunks have equal
    ids, and only chunks not yet seen are given to the tokenizer. The table of known chunks is emptied at
    ``known`` entries, so memory stays bounded.
    """

    def __init__(self, tokenizer_path: str, known: int = 700_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.limit = known
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # ids of tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint16 if len(self.opens) <= 1 << 16 else np.uint32), np.zeros(1, np.int32)

    def _learn(self, chunks: list[str]) -> None:
        """Chunks with a space at their start only are encoded in one go: each starts at an id that opens."""
        joined = [c for c in chunks if c.rfind(" ") == 0]
        ids = [np.asarray(self.tokenizer.encode_batch_fast(["".join(joined)], add_special_tokens=False)[0].ids, np.int64)]
        sizes = [np.diff(np.append(np.flatnonzero(self.opens[ids[0]]), len(ids[0])))]
        if len(sizes[0]) != len(joined):
            raise ValueError("the tokenizer joined two chunks")
        for c, e in zip(others := [c for c in chunks if c.rfind(" ") != 0], self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            ids.append(np.asarray(e.ids, np.int64))
            sizes.append([len(e.ids)])
        self.place.update(zip(joined + others, range(len(self.place), len(self.place) + len(chunks))))
        self.ids = np.concatenate([self.ids, *ids], dtype=self.ids.dtype, casting="unsafe")
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))).astype(np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids per text)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        # a mark at each boundary, which then splits the text; a text with the mark or a special token is encoded whole
        odd = pc.match_substring(texts, "\x00").to_numpy(zero_copy_only=False)
        for token in self.special:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        marked = texts
        for boundary, mark in BOUNDARIES:
            marked = pc.replace_substring_regex(marked, boundary, mark)
        parts = pc.split_pattern(marked, "\x00")
        if odd.any():
            parts = pa.array([[t] if o else p for t, o, p in zip(texts.to_pylist(), odd, parts.to_pylist())], pa.large_list(pa.large_string()))
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(parts).dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.place) + len(chunks) > self.limit:
            self._clear()
        if new := [c for c in chunks if c not in self.place]:
            self._learn(new)
        places = np.fromiter(map(self.place.__getitem__, chunks), np.int32, len(chunks))
        which = places[coded.indices.to_numpy()] if len(chunks) else np.zeros(0, np.int32)
        firsts = self.ends[which]
        sizes = self.ends[which + 1] - firsts
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        flat = np.arange(edges[-1], dtype=np.int32) + np.repeat(firsts - edges[:-1].astype(np.int32), sizes)
        cuts = np.concatenate([[0], np.cumsum(per_text)])
        return self.ids[flat], edges[cuts[1:]] - edges[cuts[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One per Python worker, which serves many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _SequenceFile:
    """Ids appended in any portions, written as full rows; closing pads the last one."""

    def __init__(self, sink, length: int, id_type: pa.DataType):
        self.length, self.id_type = length, id_type
        self.schema = pa.schema([("ids", pa.list_(id_type, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * BATCH_ROWS:
            self._write(self.length * BATCH_ROWS)

    def _write(self, step: int, padded: bool = False) -> None:
        ids = np.concatenate(self.held)
        at = 0
        while self.n - at >= step or padded and at < self.n:
            part = ids[at : at + step]
            rows = -(-len(part) // self.length)
            flat, mask = np.zeros(rows * self.length, self.id_type.to_pandas_dtype()), np.zeros(rows * self.length, bool)
            flat[: len(part)], mask[: len(part)] = part, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
            at += len(part)
        self.held, self.n = [ids[at:]], self.n - at

    def close(self) -> None:
        if self.n:
            self._write(self.length * BATCH_ROWS, padded=True)
        self.writer.close()


def write_token_files(
    df: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, length: int = LENGTH, id_type: str = "uint16", text_bytes: int = 2 << 20,
) -> DataFrame:
    """Encode every text, append ``end_id``, write the files; returns (part, file, index_file, documents, tokens).

    A NULL or empty text is the end id alone. Rows are dealt out by ranges of (id, hash of the text) and sorted:
    NULL ids first, equal ids by hash, so one id on many rows doesn't fill one task. A task holds one batch of
    texts of about ``text_bytes`` at a time. ``id_type`` must hold the vocabulary: uint16 up to 65,536 ids.
    Files bear the task attempt's number; the returned table, written at once, lists those of successful tasks.
    """
    folder = shared_folder(df.sparkSession, "token-files")
    make_folder(folder)
    kind = {"uint16": pa.uint16(), "uint32": pa.uint32()}[id_type]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        at, total = 0, np.cumsum(sizes)
        while at < len(sizes):
            upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + text_bytes)))
            yield batch.slice(at, upto - at)
            at = upto

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, encoder = TaskContext.get(), _encoder(tokenizer_path)
        system, inner = open_at(folder)
        stem = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        documents = tokens = 0
        with system.open_output_stream(f"{inner}/{stem}.arrow", compression=None) as sink, system.open_output_stream(f"{inner}/{stem}.index.arrow", compression=None) as beside:
            out, index = _SequenceFile(sink, length, kind), pa.ipc.new_file(beside, INDEX)
            for batch in batches:
                for part in slices(batch):
                    ids, sizes = encoder.encode(part.column("text"))
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                    out.add(ids.astype(kind.to_pandas_dtype()))
                    starts = tokens + np.cumsum(sizes) - sizes
                    index.write_batch(pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(starts), pa.array(sizes)], schema=INDEX))
                    documents, tokens = documents + len(sizes), tokens + int(sizes.sum())
            out.close()
            index.close()
        line = {"part": context.partitionId(), "file": f"{folder}/{stem}.arrow", "index_file": f"{folder}/{stem}.index.arrow", "documents": documents, "tokens": tokens}
        types = pa.schema([("part", pa.int32()), ("file", pa.string()), ("index_file", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64())])
        yield pa.RecordBatch.from_pylist([line] if documents else [], types)

    return written(rows.mapInArrow(write, MANIFEST), "token-manifest")


def read_sequence(file: str, row: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) of one sequence of a local file by memory map; the ids are a view of the mapped buffer."""
    reader = pa.ipc.open_file(pa.memory_map(open_at(file)[1]))
    batch = reader.get_batch(row // BATCH_ROWS)
    ids, mask = batch.column("ids")[row % BATCH_ROWS].values, batch.column("mask")[row % BATCH_ROWS].values
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32 [, ids]) per document, from the files.

    ``start`` counts the ids of all documents before it: those of earlier files, by a running sum over the
    manifest (one row per file), plus the place in its own file. ids_crc32 is taken over little-endian unsigned
    32-bit ids. A file is read batch by batch; a document's ids may span batches.
    """
    earlier = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", earlier)
    files = files.repartition(max(1, manifest.count()), "file")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids)

    def stream(reader: pa.RecordBatchFileReader) -> Iterator[np.ndarray]:
        for i in range(reader.num_record_batches):
            batch = reader.get_batch(i)
            ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten().to_numpy(zero_copy_only=False)
            yield ids[mask].astype("<u4")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                with open_at(line["file"])[0].open_input_file(open_at(line["file"])[1]) as data, open_at(line["index_file"])[0].open_input_file(open_at(line["index_file"])[1]) as beside:
                    portions, index = stream(pa.ipc.open_file(data)), pa.ipc.open_file(beside)
                    held, at = np.zeros(0, "<u4"), 0
                    for i in range(index.num_record_batches):
                        part = index.get_batch(i)
                        sizes = part.column("n_tokens").to_numpy()
                        crc, own = np.zeros(len(sizes), np.int64), []
                        for k, n in enumerate(sizes):
                            while len(held) - at < n:
                                held, at = np.concatenate([held[at:], next(portions)]), 0
                            ids = held[at : at + n]
                            crc[k] = zlib.crc32(ids.tobytes())
                            if with_ids:
                                own.append(ids.astype(np.int32))
                            at += n
                        columns = [part.column("doc_id"), pa.array(part.column("start").to_numpy() + line["base"]), part.column("n_tokens"), pa.array(crc)]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * with_ids, schema=schema)

    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return files.select("file", "index_file", "base").mapInArrow(read, kinds)
