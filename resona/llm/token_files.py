"""Token ids as Arrow files of equal-length sequences with masks.

One file per range of document ids ("shard"). A shard is the stream of its documents' ids, each document
closed by an end id, in ascending ``doc_id`` order, cut into sequences of ``LENGTH`` ids. Its record batches
have two fixed-size-list columns, ``ids`` (unsigned, 16 bits where the vocabulary allows, else 32) and
``mask`` (bits, false in the padding that only a shard's last sequence has), uncompressed, and all but the
last batch hold ``PER_BATCH`` sequences. So the place of any id follows by division, and a memory-mapped
reader takes views of it without copying. Two list columns say which documents start in a sequence: ``doc_id``
and ``doc_start``, their place in it. A document ends where the next one starts, the last where the mask does.
The folder's ``manifest`` table names the shards and their files; everything else is read from the files.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import folder_uri, in_parts, kept, map_arrow, read_docs

LENGTH = 2048
PER_BATCH = 64
# Entries of a worker's tables of known chunks and words. A full table becomes the older one, from which entries
# that are met again return; none of this changes a result.
KNOWN_CHUNKS = 200_000
KNOWN_WORDS = 400_000
# Bytes of text that are encoded at a time.
PART_BYTES = 4 << 20

# The tokenizer file's word pattern (fields of its JSON), and its letters and numbers below
# U+0180 after lower-casing. Chunks with other characters go to the library.
FILE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Chunks hold no line end, which is put between them.
WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-žſ]+|[0-9²³¹¼-¾]|[^a-zªµºß-öø-žſ0-9²³¹¼-¾\n]+|\n")
OTHER = re.compile("[^\x00-įı-ſ]")
# Blanks for Python's split, but not for the tokenizer.
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


class Recent:
    """Packed ids of recent strings, in a younger and an older table."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, wanted: list[str]) -> list[str]:
        """What of the distinct strings ``wanted`` is in neither table; the rest is in the younger one afterwards."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young = self.young
        lacking = [w for w in wanted if w not in young]
        if lacking and self.old:
            older = list(map(self.old.get, lacking))
            young.update({w: packed for w, packed in zip(lacking, older) if packed is not None})
            lacking = [w for w, packed in zip(lacking, older) if packed is None]
        return lacking


class Encoder:
    """Ids of whole texts under one file of the tokenizers library, as packed unsigned integers.

    Where the file drops white space and no word spans it, texts are looked up chunk by chunk; chunks and words
    not met before are encoded by the library. Any other file, and any text with an added token's string or an
    odd separator, is encoded by the library as a whole. The tables of known chunks and words are ``smaller`` times
    smaller than usual.
    """

    def __init__(self, path: str, smaller: int = 1):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.odd = "|".join(map(re.escape, (*[t["content"] for t in spec["added_tokens"]], *SEPARATORS)))
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        before = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
        self.by_chunk = (
            steps == ["NFC", "Replace", "Lowercase"]
            and before[0].get("pattern") == {"Regex": FILE_PATTERN}
            and before[0].get("behavior") == "Removed"
            and before[1].get("type") == "ByteLevel"
            and not before[1]["add_prefix_space"]
        )
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.ends = np.zeros(size, dtype=bool)
        for token, number in self.library.get_vocab(with_added_tokens=True).items():
            self.ends[number] = bool(suffix) and token.endswith(suffix)
        self.chunks, self.words = Recent(KNOWN_CHUNKS // smaller), Recent(KNOWN_WORDS // smaller)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind)

    def learn_words(self, words: list[str]) -> None:
        """Encode words many at a time; the last token of each word carries the word end."""
        groups = [words[i : i + 500] for i in range(0, len(words), 500)]
        encoded = self.library.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encoded):
            ids = np.array(encoding.ids, dtype=self.kind)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(group) or (len(stops) and stops[-1] != len(ids)):
                self.words.young.update((w, self.whole(w).tobytes()) for w in group)
                continue
            packed, width, start = ids.tobytes(), self.kind.itemsize, 0
            for word, stop in zip(group, stops.tolist()):
                self.words.young[word] = packed[start * width : stop * width]
                start = stop

    def learn(self, chunks: list[str]) -> None:
        """Put distinct chunks (an empty one is what blanks at either end of a text leave) in the younger table. Their words are found in one go, since a call per chunk takes longer than its words."""
        packed, plain = self.chunks.young, []
        for chunk in chunks:
            if chunk.isascii() or not OTHER.search(chunk):
                plain.append(chunk)
            else:
                packed[chunk] = self.whole(chunk).tobytes()
        if not plain:
            return
        words = WORD.findall("\n".join(plain).lower())
        distinct = list(set(words) - {"\n"})
        self.learn_words(self.words.missing(distinct))
        known = self.words.young
        known["\n"] = b""
        pieces = list(map(known.__getitem__, words))
        stops = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        between = [i for i, word in enumerate(words) if word == "\n"]
        joined = b"".join(pieces)
        cuts = [0, *stops[between].tolist(), len(joined)]
        packed.update(zip(plain, [joined[a:b] for a, b in zip(cuts, cuts[1:])]))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """Ids of each text (none is null). Only the distinct chunks of all texts are looked up; their ids are then gathered."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_chunk:
            return [self.whole(t) for t in texts.to_pylist()]
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if odd.any():
            texts, whole = pc.if_else(pa.array(odd), "", texts), {i: self.whole(texts[i].as_py()) for i in np.flatnonzero(odd).tolist()}
        cut = pc.utf8_split_whitespace(texts)
        chunks = cut.flatten().dictionary_encode()
        # Arrow makes Python's strings much faster on the way to numpy than by to_pylist.
        distinct, place = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy()
        self.learn(self.chunks.missing(distinct))
        packed = list(map(self.chunks.young.__getitem__, distinct))
        sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // self.kind.itemsize
        counts = sizes[place]
        stops = np.cumsum(counts)
        spots = np.repeat((np.cumsum(sizes) - sizes)[place] - (stops - counts), counts) + np.arange(counts.sum())
        ids = np.frombuffer(b"".join(packed), self.kind)[spots]
        ends = np.append(0, stops)[np.cumsum(cut.value_lengths().to_numpy())]
        out = np.split(ids, ends[:-1])
        if odd.any():
            out = [whole.get(i, x) for i, x in enumerate(out)]
        return out


def encoder(path: str, smaller: int = 1) -> Encoder:
    """The worker's encoder for a file, kept between tasks."""
    # A task has one core; threads of the library would each hold memory of their own.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("encoder", path, str(smaller)), lambda: Encoder(path, smaller))


class ShardWriter:
    """Writes one shard; a name of its own per attempt, so that a repeated task never meets an earlier one's file."""

    def __init__(self, folder: str, shard: int, kind: np.dtype, length: int, per_batch: int):
        self.uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        self.kind, self.length, self.per_batch = kind, length, per_batch
        store, path = fs.FileSystem.from_uri(self.uri)
        self.sink = store.open_output_stream(path)
        values = pa.from_numpy_dtype(kind)
        lists = {"ids": pa.list_(values, length), "mask": pa.list_(pa.bool_(), length), "doc_id": pa.list_(pa.int64()), "doc_start": pa.list_(pa.int32())}
        self.schema = pa.schema(lists)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.held = bytearray()
        self.starting: list[tuple[int | None, int]] = []  # documents that start in what is held, with their place in it
        self.total = self.documents = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """Append one document's packed ids."""
        self.starting.append((doc_id, len(self.held) // self.kind.itemsize))
        self.held += ids
        self.total += len(ids) // self.kind.itemsize
        self.documents += 1
        room = self.per_batch * self.length
        full = room * self.kind.itemsize
        while len(self.held) >= full:
            self.put(bytes(self.held[:full]), [s for s in self.starting if s[1] < room])
            del self.held[:full]
            self.starting = [(i, place - room) for i, place in self.starting if place >= room]

    def put(self, packed: bytes, starting: list[tuple[int | None, int]]) -> None:
        ids = np.frombuffer(packed, dtype=self.kind)
        gap = -len(ids) % self.length
        mask = np.ones(len(ids) + gap, dtype=bool)
        if gap:
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(gap, dtype=self.kind)])
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        places = np.array([place for _, place in starting], np.int64)
        offsets = pa.array(np.searchsorted(places, np.arange(len(ids) // self.length + 1) * self.length).astype(np.int32))
        lists.append(pa.ListArray.from_arrays(offsets, pa.array([i for i, _ in starting], pa.int64())))
        lists.append(pa.ListArray.from_arrays(offsets, pa.array((places % self.length).astype(np.int32))))
        self.file.write_batch(pa.record_batch(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.put(bytes(self.held), self.starting)
        self.file.close()
        self.sink.close()


class ShardReader:
    """Random access to a shard; views without copying where the file can be mapped into memory."""

    def __init__(self, uri: str):
        store, path = fs.FileSystem.from_uri(uri)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else store.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        first = self.file.get_batch(0) if self.file.num_record_batches else None
        self.per_batch = first.num_rows if first is not None else 0
        self.held = (0, first)

    def batch(self, number: int) -> pa.RecordBatch:
        if self.held[0] != number:
            self.held = (number, self.file.get_batch(number))
        return self.held[1]

    def sequence(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one sequence."""
        batch, row = self.batch(number // self.per_batch), number % self.per_batch
        ids = batch.column("ids")[row].values.to_numpy(zero_copy_only=True)
        return ids, batch.column("mask")[row].values.to_numpy(zero_copy_only=False)

    def span(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on, in the shard's stream."""
        room, parts = self.per_batch * self.length, []
        while count > 0:
            values = self.batch(start // room).column("ids").values.to_numpy(zero_copy_only=True)
            part = values[start % room : start % room + count]
            parts.append(part)
            start, count = start + len(part), count - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def total(self) -> int:
        """Ids of the shard, without padding: only the last sequence may have some."""
        if not self.per_batch:
            return 0
        last = self.batch(self.file.num_record_batches - 1)
        before = ((self.file.num_record_batches - 1) * self.per_batch + last.num_rows - 1) * self.length
        return before + int(np.count_nonzero(last.column("mask")[last.num_rows - 1].values.to_numpy(zero_copy_only=False)))

    def documents(self) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """Per batch: the documents that start in it, and their places in the shard's stream."""
        for number in range(self.file.num_record_batches):
            batch = self.file.get_batch(number)
            sequence = number * self.per_batch + np.repeat(np.arange(batch.num_rows), batch.column("doc_id").value_lengths().to_numpy())
            yield batch.column("doc_id").flatten().to_pylist(), sequence * self.length + batch.column("doc_start").flatten().to_numpy()

    def close(self) -> None:
        self.source.close()


MANIFEST = "shard int, file string, documents long, n_tokens long"


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, length: int = LENGTH, per_batch: int = PER_BATCH, smaller: int = 1
) -> DataFrame:
    """Encode every whole text, write the shards below ``folder`` (a URI all executors reach), and return its manifest.

    The manifest has a row per shard: ``shard``, ``file``, ``documents``, ``n_tokens``. It is the table ``folder/manifest``:
    a task that is repeated writes a new file, and only files of the manifest count. A null or empty text
    is the end id alone. Null ids come first; rows of one id are ordered by text, so repeated rows are adjacent.
    An empty table writes no file. Columns other than ``doc_id`` and ``text`` are ignored. ``smaller`` divides a worker's
    tables and the text it encodes at a time: less memory for more time, and the same files.
    """
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, shard, writer = encoder(tokenizer, smaller), TaskContext.get().partitionId(), None
        close = np.array([end_id], dtype=encoding.kind).tobytes()
        for batch in batches:
            for part in in_parts(batch, PART_BYTES // smaller):
                if writer is None:
                    writer = ShardWriter(folder, shard, encoding.kind, length, per_batch)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoding.encode(part.column("text"))):
                    writer.add(doc_id, ids.tobytes() + close)
        if writer is not None:
            writer.close()
            yield pa.record_batch(
                [pa.array([shard], pa.int32()), pa.array([writer.uri]), pa.array([writer.documents], pa.int64()), pa.array([writer.total], pa.int64())],
                names=["shard", "file", "documents", "n_tokens"],
            )

    rows = docs_for_files(docs)
    map_arrow(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"), task, MANIFEST).write.parquet(f"{folder}/manifest")
    return open_token_files(docs.sparkSession, folder)


def docs_for_files(docs: DataFrame) -> DataFrame:
    return read_docs(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def open_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder of token files that were written before."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document ``(doc_id, start, n_tokens, ids_crc32)``, from the files that the manifest names.

    ``start`` counts the ids of all documents before it, of earlier shards too. The checksum is over the ids as
    little-endian unsigned 32-bit integers. Only ids in unmasked places belong to a document.
    """
    files = manifest.select("shard", "file").repartition("shard")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("file").to_pylist():
                reader = ShardReader(uri)
                found.append(reader.total())
                reader.close()
            yield pa.record_batch([batch.column("shard"), pa.array(found, pa.int64())], names=["shard", "total"])

    # One row per shard, of which there are as many as partitions.
    before, offsets = 0, []
    for shard, total in sorted(tuple(r) for r in map_arrow(files, totals, "shard int, total long").collect()):
        offsets.append((shard, before))
        before += total
    bases = files.sparkSession.createDataFrame(offsets, "shard int, base long")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                reader = ShardReader(uri)
                yield from digests(reader, base)
                reader.close()

    return map_arrow(files.join(F.broadcast(bases), "shard").select("file", "base"), task, DIGEST)


def digests(reader: ShardReader, base: int) -> Iterator[pa.RecordBatch]:
    """Digest rows of a shard, a batch's documents at a time; a document may reach into the batches that follow."""

    def rows(ids: list, starts: np.ndarray, end: int) -> pa.RecordBatch:
        counts = np.diff(np.append(starts, end))
        sums = [zlib.crc32(reader.span(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), counts.tolist())]
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(counts), pa.array(sums, pa.int64())],
            names=["doc_id", "start", "n_tokens", "ids_crc32"],
        )

    held: tuple[list, np.ndarray] | None = None
    for ids, starts in reader.documents():
        if not ids:
            continue
        if held is not None:
            yield rows(*held, int(starts[0]))
        held = (ids, starts.astype(np.int64))
    if held is not None:
        yield rows(*held, reader.total())


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, smaller: int = 1) -> DataFrame:
    """Write ``docs`` as token files in ``folder`` (a new one in the session's shared folder) and return the digest read back.

    Null, empty and repeated rows, and ``smaller``: see ``write_token_files``; an empty table gives no rows. ``open_token_files`` reopens a folder.
    """
    folder = folder or folder_uri(docs.sparkSession, f"token-files-{uuid.uuid4().hex}")
    return read_token_files(write_token_files(docs, tokenizer, folder, end_id, smaller=smaller))
