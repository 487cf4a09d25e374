"""Token counts by rank-synchronous merging of batched byte-level BPE pre-tokens.

The distinct pre-tokens of a batch are laid out as one ragged array of symbol ids. In each round every
pre-token applies its lowest-ranked pair, all pre-tokens at once, until no pair is left; the symbols that
survive are its tokens. Pre-tokens seen before are looked up in a bounded table per Python worker.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import arrow_rows, kept, map_arrow, read_docs

# Entries of a worker's tables of known pieces; a full table is emptied, which changes no result.
KNOWN = 600_000

# The byte-level pre-tokenizer's contractions and character classes below U+0250, where every
# character from U+0100 on is a letter. Other characters are left to the tokenizer file's own pre-tokenizer.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = "\t-\r \x85\xa0"
PIECE = re.compile(
    f"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
FOREIGN = re.compile("[^\x00-ɏ]")
# Blanks other than a single space or line feed, and blanks next to a space: such texts are split whole.
ODD = ("  ", " \n", "\n ", "\t", "\x0b", "\x0c", "\r", "\x85", "\xa0", *map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class MergeCounter:
    """Number of tokens of texts under one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with options aren't supported")
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.marks = contents
        vocabulary = model["vocab"]
        self.first = np.array([vocabulary[s] for s in byte_symbols()], dtype=np.int64)
        self.width = max(vocabulary.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.width + vocabulary[b] for a, b in pairs], dtype=np.int64)
        merged = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.merged = keys[order], order, merged
        self.path, self.library = path, None
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def symbols_left(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols per byte string, after all merges; strings must not be empty."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        counts = lengths.copy()
        none = len(self.ranks)
        while len(symbol) > 1:
            key = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(owner)])
            # A finished string has no pair left; it needs no further rounds.
            alive = np.repeat(lowest < none, sizes)
            if not alive.any():
                break
            chosen = rank == np.repeat(lowest, sizes)[:-1]
            chosen &= rank < none
            # Of overlapping pairs (a run of one symbol) every other one merges, from the left.
            spots = np.flatnonzero(chosen)
            run = np.flatnonzero(np.r_[True, np.diff(spots) > 1])
            within = np.arange(len(spots)) - np.repeat(run, np.diff(np.r_[run, len(spots)]))
            spots = spots[within % 2 == 0]
            symbol[spots] = self.merged[rank[spots]]
            np.subtract.at(counts, owner[spots], 1)
            keep = alive
            keep[spots + 1] = False
            symbol, owner = symbol[keep], owner[keep]
        return counts

    def split(self, text: str) -> list[str]:
        """Pre-tokens; those of other scripts come from the file's own pre-tokenizer, as bytes shown in Latin-1."""
        if not FOREIGN.search(text):
            return PIECE.findall(text)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[start:end] for _, (start, end) in self.library.pre_tokenize_str(text)]

    def learn(self, found: dict[str, list[str]]) -> None:
        """Add the counts of pieces, given with their pre-tokens, to the tables."""
        new = list({w for words in found.values() for w in words if w not in self.words})
        if len(self.words) + len(new) > KNOWN:
            self.words = {}
            new = list({w for words in found.values() for w in words})
        for start in range(0, len(new), 50_000):
            part = new[start : start + 50_000]
            counts = self.symbols_left([w.encode() for w in part])
            self.words.update(zip(part, counts.tolist()))
        if len(self.pieces) + len(found) > KNOWN:
            self.pieces = {}
        known = self.words
        for piece, words in found.items():
            self.pieces[piece] = known[words[0]] if len(words) == 1 else sum(known[w] for w in words)

    def plain(self, texts: list[str]) -> list[int]:
        """Tokens of texts without added tokens.

        A cut before a single space between two other characters is a pre-token's border, so texts with no
        other blanks next to a space are looked up by space-led pieces; the rest are split whole.
        """
        cuts = []
        for text in texts:
            if not text:
                cuts.append([])
            elif any(odd in text for odd in ODD):
                cuts.append(self.split(text))  # each pre-token is a piece of its own
            else:
                first, *rest = text.split(" ")
                cuts.append([*self.split(first), *[" " + p for p in rest]])
        wanted = set().union(*cuts)
        if len(self.pieces) + len(wanted) > KNOWN:
            self.pieces = {}
        missing = [p for p in wanted if p not in self.pieces]
        if missing:
            self.learn({p: self.split(p) for p in missing})
        get = self.pieces.__getitem__
        return [sum(map(get, c)) for c in cuts]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts; a special string inside a text is one token and parts the text."""
        special = {i for i, text in enumerate(texts) if any(m in text for m in self.marks)}
        if not special:
            return self.plain(texts)
        totals = self.plain(["" if i in special else t for i, t in enumerate(texts)])
        for i in special:
            parts = self.added.split(texts[i])
            totals[i] = sum(self.plain(parts)) + len(parts) - 1
        return totals


def counter(path: str) -> MergeCounter:
    """The worker's counter for a file, kept between tasks."""
    return kept(("counter", path), lambda: MergeCounter(path))


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` per row of ``docs``, over whole texts.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can read. A null text counts as
    empty: 0 bytes, 0 tokens. Repeated rows give repeated rows, a null id stays null, an empty table gives an
    empty one, and columns other than ``doc_id`` and ``text`` are ignored whatever their names.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = counter(tokenizer)
        for part, (ids, texts) in arrow_rows(batches, "doc_id", "text"):
            texts = [t or "" for t in texts]
            counts = counting.count(texts)
            n_bytes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return map_arrow(read_docs(docs).withColumn("doc_id", F.col("doc_id").cast("long")), task, SCHEMA)
