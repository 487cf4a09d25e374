"""Token counts and token files against the tokenizers library."""

import json
import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from brute import merges_count
from samples import ordered
from tokenizers import Tokenizer

from resona.llm import frames, token_files as files
from resona.llm.frames import folder_uri
from resona.llm.token_counts import PIECE, MergeCounter, byte_symbols, token_counts
from resona.llm.token_files import Encoder, ShardReader, open_token_files, read_token_files, token_files, write_token_files

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd_texts():
    r = random.Random(1)
    chars = " \n\tabcé'stSİŸŉ1²日.!<|😀́\xa0\x1c "
    made = ["".join(r.choice(chars) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    return [*made, "", " ", "a  b", "don't we'll", "aaaaaaa aaaa", "a<|endoftext|><|endoftext|>b", "x" * 3000, "<|STARTOFTEXT|>", "ſ ƀ ɏ ɐ Ⱥ"]


def test_counts_equal_the_library(odd_texts):
    library = Tokenizer.from_file(BYTES)
    wanted = [len(e.ids) for e in library.encode_batch(odd_texts, add_special_tokens=False)]
    assert MergeCounter(BYTES).count(odd_texts) == wanted


def test_counts_equal_one_merge_at_a_time():
    with open(BYTES, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    texts = ["banana bandana", "aaaaaaaaa", "the theatre's thesis", "x1y22"]
    wanted = [merges_count(t, model["vocab"], ranks, PIECE, byte_symbols()) for t in texts]
    assert MergeCounter(BYTES).count(texts) == wanted


def test_counts_of_odd_rows(docs, no_docs, rows):
    library = Tokenizer.from_file(BYTES)
    wanted = []
    for i, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        wanted.append((i, len((text or "").encode()), n, n > 512))
    assert ordered(token_counts(docs, BYTES)) == sorted(wanted, key=lambda r: ((r[0] is not None), r[0] or 0, *r[1:]))
    assert token_counts(no_docs, BYTES).count() == 0


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_equal_the_library(odd_texts, path):
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    encoder.chunks.most = encoder.words.most = 50  # full tables change nothing
    for start in range(0, len(odd_texts), 200):
        part = odd_texts[start : start + 200]
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(part)]
        assert got == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]


def test_files_read_back(docs, no_docs, rows):
    library = Tokenizer.from_file(WORDS)
    start, wanted = 0, []
    for i, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())):
        ids = [*library.encode(text, add_special_tokens=False).ids, 1]
        wanted.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = ordered(token_files(docs, WORDS), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got == sorted(wanted, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    assert token_files(no_docs, WORDS).count() == 0


def test_sequences_and_masks(spark, docs, rows):
    library = Tokenizer.from_file(WORDS)
    folder = folder_uri(spark, "sequences")
    manifest = write_token_files(docs, WORDS, folder, length=16, per_batch=3)
    wanted = sorted((r[0] is not None, r[0] or 0, [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows)
    seen = []
    for row in sorted(manifest.collect()):
        assert re.match("file:///", row["file"])
        reader, total = ShardReader(row["file"]), row["n_tokens"]
        assert reader.total() == total
        ids = [reader.sequence(k) for k in range(-(-total // 16))]
        assert all(len(i) == 16 and len(m) == 16 for i, m in ids)
        assert np.concatenate([m for _, m in ids]).tolist() == [k < total for k in range(len(ids) * 16)]
        flat = np.concatenate([i for i, _ in ids])
        found = [(i, int(s)) for names, starts in reader.documents() for i, s in zip(names, starts)]
        assert len(found) == row["documents"]
        for (i, start), (_, end) in zip(found, [*found[1:], (None, total)]):
            assert flat[start:end].tolist() == reader.span(start, end - start).tolist()
            seen.append((i is not None, i or 0, flat[start:end].tolist()))
        reader.close()
    assert sorted(seen) == wanted
    # A folder written before is opened by its path alone.
    assert ordered(read_token_files(open_token_files(spark, folder))) == ordered(token_files(docs, WORDS))


def test_a_very_long_text(spark):
    """20,000 words among short ones, for counts, ids and files."""
    r = random.Random(6)
    long = " ".join("".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 9))) for _ in range(20_000))
    texts = [(1, "short"), (2, long), (3, long[::-1]), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for path, found in ((WORDS, token_files(docs, WORDS)), (BYTES, token_counts(docs, BYTES))):
        wanted = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch([t for _, t in texts], add_special_tokens=False)]
        assert [n - (path == WORDS) for _, n in ordered(found, "doc_id", "n_tokens")] == wanted


def test_blanks_are_those_of_the_split():
    """Arrow cuts texts where Python's split does, over all characters."""
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    cut = pc.utf8_split_whitespace(pa.array([f"a{c}b" for c in every])).value_lengths().to_numpy() > 1
    assert [c for c, k in zip(every, cut) if k] == [c for c in every if c.isspace()]


def test_words_of_a_batch_are_found_at_once(monkeypatch):
    """A call per chunk took more CPU than the words themselves."""
    calls = []

    class Counting:
        def findall(self, text):
            calls.append(text)
            return word.findall(text)

    word = files.WORD
    monkeypatch.setattr(files, "WORD", Counting())
    encoder = Encoder(WORDS)
    texts = ["", "  ", " It's 42 o'clock,isn't it? ", "Größe\nÇa va²  x\ty", "\x1cΣΑΣ ſtraße", "a\r\nb\x0bc\x85d\xa0e f", "ab<|endoftext|>cd"] + [f"w{i} v-{i}'s" for i in range(50)]
    for _ in range(2):
        found = encoder.encode(texts)
        assert [x.tolist() for x in found] == [encoder.whole(t).tolist() for t in texts]
    assert len(calls) == 1


def test_tables_of_known_strings_keep_what_is_met_again(monkeypatch):
    monkeypatch.setattr(files, "KNOWN_CHUNKS", 3)
    monkeypatch.setattr(files, "KNOWN_WORDS", 3)
    encoder = Encoder(WORDS)
    for i in range(12):
        texts = [" again and ", f"new{i} and again", f"x{i // 3}y, {i}", ""]
        assert [x.tolist() for x in encoder.encode(texts)] == [encoder.whole(t).tolist() for t in texts]


def test_smaller_tables_give_the_same_files(spark, docs):
    found = [ordered(files.token_files(docs, WORDS, smaller=n), "doc_id", "start", "n_tokens", "ids_crc32") for n in (1, 100_000)]
    assert found[0] and found[0] == found[1]


def test_free_memory_is_returned_between_batches(monkeypatch):
    """Only the end of a task returned it, so that workers kept the most that any batch had needed."""
    calls = []
    monkeypatch.setattr(frames, "release", lambda: calls.append(1))
    seen = [len(calls) for _ in frames.released(iter([pa.record_batch([pa.array([i])], names=["i"]) for i in range(3)]))]
    assert seen == [0, 1, 2] and len(calls) == 3


def test_a_worker_drops_a_table_that_a_task_does_not_ask_for(spark):
    """Encoders of an earlier stage stayed beside all later ones."""
    key = ("table of this test",)

    def asking(batches):
        for batch in batches:
            frames.kept(key, lambda: "table")
            yield pa.record_batch([pa.array([os.getpid()] * batch.num_rows, pa.int64()), pa.array([key in frames._kept] * batch.num_rows)], names=["pid", "held"])

    def plain(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([os.getpid()] * batch.num_rows, pa.int64()), pa.array([key in frames._kept] * batch.num_rows)], names=["pid", "held"])

    # Without Spark: a task that asks keeps the table, one that doesn't drops it.
    frames.begin_task()
    assert frames.kept(key, lambda: "first") == "first"
    frames.end_task()
    frames.begin_task()
    assert frames.kept(key, lambda: "second") == "first"
    frames.end_task()
    frames.begin_task()
    frames.end_task()
    assert key not in frames._kept
    # In workers: whatever worker ran the second of these, the third finds nothing in it.
    one = spark.range(1).coalesce(1)
    held = [{r.pid: r.held for r in frames.map_arrow(one, task, "pid long, held boolean").collect()} for task in (asking, plain, plain)]
    assert all(held[0].values())
    assert not any(held[2][pid] for pid in held[1] if pid in held[2])
