"""Cutting one text to budgets, and finding longest prefixes under a count: small functions that the operators call per
row or context inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from math import ceil

#: The end of a sentence with the space after it.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def sentences(text: str) -> Iterator[str]:
    """A text's sentences with the space that follows them; they join to the text."""
    start = 0
    for gap in SENTENCE_END.finditer(text):
        yield text[start : gap.end()]
        start = gap.end()
    if start < len(text):
        yield text[start:]


def slices(text: str, most_bytes: int, most_chars: int) -> Iterator[str]:
    """The longest pieces within both bounds, cut between code points."""
    data, start = text.encode("utf-8", "surrogatepass"), 0
    while start < len(data):
        stop = min(start + most_bytes, len(data))
        while stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        piece = data[start:stop].decode("utf-8", "surrogatepass")[:most_chars]
        yield piece
        start += len(piece.encode("utf-8", "surrogatepass"))


def budget_cuts(text: str, most_bytes: int, most_tokens: int, per_token: float) -> list[tuple[int, int]]:
    """(start, stop) of consecutive pieces of a text, each within `most_bytes` of UTF-8 and `most_tokens` tokens of
    `per_token` characters: whole lines as long as they fit; a line that doesn't fit by itself is cut into sentences, and
    a sentence that doesn't into the longest slices. Neither joins what stands beside it."""
    tokens = lambda chars: max(1, int(chars / per_token))
    fits = lambda chars, size: size <= most_bytes and tokens(chars) <= most_tokens
    out: list[tuple[int, int]] = []
    start = stop = held = 0  # the piece that is being filled, and its bytes

    def close() -> None:
        nonlocal start, held
        if stop > start:
            out.append((start, stop))
        start, held = stop, 0

    def put(chars: int, size: int) -> None:
        nonlocal stop, held
        if stop > start and not fits(stop + chars - start, held + size):
            close()
        stop, held = stop + chars, held + size

    for line in text.splitlines(keepends=True):
        size = len(line.encode("utf-8", "surrogatepass"))
        if fits(len(line), size):
            put(len(line), size)
            continue
        close()
        for sentence in sentences(line):
            size = len(sentence.encode("utf-8", "surrogatepass"))
            if fits(len(sentence), size):
                put(len(sentence), size)
                continue
            close()
            for piece in slices(sentence, most_bytes, ceil((most_tokens + 1) * per_token) - 1):
                stop += len(piece)
                close()
        close()
    close()
    return out


def counted_cuts(text: str, most_bytes: int, most_tokens: int, count: Callable[[str], int], sample: int = 256_000) -> list[tuple[int, int]]:
    """budget_cuts by a true count: characters a token are measured on the text's beginning, and a piece that counts too
    many is halved until its parts don't, down to single characters."""
    if not text:
        return []
    first = text[:sample]
    waiting = budget_cuts(text, most_bytes, most_tokens, max(1.0, len(first) / max(1, count(first))))[::-1]
    out = []
    while waiting:
        start, stop = waiting.pop()
        if stop - start > 1 and count(text[start:stop]) > most_tokens:
            half = (start + stop) // 2
            waiting += [(half, stop), (start, half)]
        else:
            out.append((start, stop))
    return out


def prefix_chunks(n: int, most: int, count: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """(start, stop) runs of n parts, each the longest that counts `most` at most; a part that counts more is alone.
    count(start, stop) doesn't fall as the stop grows. The stop is looked for in doubled steps, then by halves."""
    out, start = [], 0
    while start < n:
        good, bad, step = start + 1, n + 1, 1
        if count(start, good) <= most:
            while good < n and bad > n:
                probe = min(n, good + step)
                if count(start, probe) <= most:
                    good, step = probe, 2 * step
                else:
                    bad = probe
            while bad <= n and good + 1 < bad:
                half = (good + bad) // 2
                if count(start, half) <= most:
                    good = half
                else:
                    bad = half
        out.append((start, good))
        start = good
    return out
