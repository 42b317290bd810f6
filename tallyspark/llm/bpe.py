"""Byte-level BPE by tree reduction: halves are encoded apart and joined at their boundary.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours, encoded together, stay those
two tokens. Joining two encodings therefore re-encodes a window around the boundary and widens it until the pairs
at the window's edges are stable; then no token outside can change. Decoding concatenates byte strings up the same
kind of tree.

Rows: a null text counts as empty (0 tokens, the hash of nothing); null ids and repeated rows are kept as they
are; only `doc_id` and `text` are read, so further columns can't clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows, small_batches

#: A part this short is encoded directly; longer ones are halved.
LEAF_BYTES = 3
#: Halves this short are remembered.
HALF_BYTES = 8
#: Tokens on each side of a boundary that the first window takes.
FIRST_WINDOW = 2
#: Chunks whose ids a task remembers; the memory of a task is bounded by it.
CACHE = 250_000
#: Tokens that one leaf of the decoding tree joins.
DECODE_LEAF = 32
#: Marks that form one match where they end a chunk of letters (the apostrophe may begin another kind).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: A space that the pattern may take together with other white space.
UNSAFE_SPACE = re.compile(r" (?:\s|\Z)").search


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class TreeBpe(dict):
    """Encodes and decodes; as a dictionary it remembers the ids of chunks that follow a space."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.ranks, self.match = ranks, regex.compile(pattern).findall
        self.token = {rank: token for token, rank in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.halves: dict[bytes, list[int]] = {}
        self.matches: dict[str, bytes] = {}

    def leaf(self, data: bytes) -> list[int]:
        """Merge the pair of the lowest rank, leftmost first, until none is left."""
        get, none = self.ranks.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            i = pairs.index(best)
            merged = parts[i] = parts[i] + parts[i + 1]
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(merged + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + merged, none)
        ranks = self.ranks
        return [ranks[p] for p in parts]

    def pair_is_stable(self, a: int, b: int) -> bool:
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= CACHE:
                self.stable.clear()
            known = self.stable[a, b] = self.leaf(self.token[a] + self.token[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.pair_is_stable(left[-1], right[0]):
            return left + right
        size = FIRST_WINDOW
        while True:
            head, tail = left[:-size], right[size:]
            data = b"".join(map(self.token.__getitem__, left[-size:] + right[:size]))
            middle = self.leaf(data)
            if (not head or self.pair_is_stable(head[-1], middle[0])) and (not tail or self.pair_is_stable(middle[-1], tail[0])):
                return head + middle + tail
            size *= 2

    def encode_match(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) <= LEAF_BYTES:
            return self.leaf(data)
        half = len(data) // 2
        left, right = data[:half], data[half:]
        return self.join(self.halves.get(left) or self.half(left), self.halves.get(right) or self.half(right))

    def half(self, data: bytes) -> list[int]:
        out = self.encode_match(data)
        if len(data) <= HALF_BYTES:
            if len(self.halves) >= CACHE:
                self.halves.clear()
            self.halves[data] = out
        return out

    def match_ids(self, match: str) -> bytes:
        out = self.matches.get(match)
        if out is None:
            ids = self.encode_match(match.encode("utf-8"))
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(match) <= 200:
                if len(self.matches) >= CACHE:
                    self.matches.clear()
                self.matches[match] = out
        return out

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a space and the chunk after it, as little-endian 32-bit integers."""
        if chunk.isalpha():
            out = self.match_ids(" " + chunk)
        elif (core := chunk.rstrip(MARKS)).isalpha():
            out = self.match_ids(" " + core) + self.match_ids(chunk[len(core) :])
        else:
            out = b"".join(map(self.match_ids, self.match(" " + chunk)))
        if len(chunk) <= 200:
            if len(self) >= CACHE:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text. A space before a visible character always begins a match, so the text may be cut there."""
        if UNSAFE_SPACE(text):
            return b"".join(map(self.match_ids, self.match(text)))
        first, *chunks = text.split(" ")
        return b"".join(map(self.match_ids, self.match(first))) + b"".join(map(self.__getitem__, chunks))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(1)
def shared_bpe(rank_path: str, pattern: str) -> TreeBpe:
    """One for each Python worker, from task to task."""
    return TreeBpe(read_ranks(rank_path), pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, binary), decoded (binary): the operator's own outputs."""
    return _run(docs, rank_path, pattern, "doc_id long, ids binary, decoded binary", lambda i, ids, raw: (i, ids, raw))


def encode_digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document; the tokens themselves never leave the task."""
    return _run(docs, rank_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", lambda i, ids, raw: (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))


def _run(docs: DataFrame, rank_path: str, pattern: str, schema: str, row) -> DataFrame:
    small_batches(docs.sparkSession)
    names = [part.split()[0] for part in schema.split(", ")]

    def make():
        bpe = shared_bpe(rank_path, pattern)

        def each(columns):
            rows = []
            for doc_id, text in zip(columns["doc_id"].to_pylist(), columns["text"].to_pylist()):
                ids = bpe.encode(text or "")
                rows.append(row(doc_id, ids, bpe.decode(np.frombuffer(ids, "<u4").tolist())))
            return dict(zip(names, map(list, zip(*rows)))) if rows else {n: [] for n in names}

        return each

    return map_rows(docs.select("doc_id", "text"), schema, make)
