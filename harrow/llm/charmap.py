"""Normalisation by a compiled character map, with the place in the source of every character it writes.

A compiled map is a double array over the UTF-8 bytes of its keys, followed by the replacements, which end in a
zero byte each. ``read_map`` lists its keys once; ``Normaliser`` then rewrites a text by the longest key that starts
at each place. Only characters that start a key are looked at one by one; runs between them keep their places by
arithmetic on the UTF-8 bytes.
"""

from __future__ import annotations

import re
import struct

import numpy as np

MARK = "▁"
SPACES = re.compile("  ")


def read_map(blob: bytes) -> dict[str, str]:
    """Key -> replacement of a compiled map; an empty one has no keys."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
    texts = blob[4 + size :]
    found: dict[str, str] = {}
    waiting = [(0, b"")]
    while waiting:
        at, key = waiting.pop()
        unit = units[at]
        base = at ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))
        if unit >> 8 & 1:  # a key ends here; its leaf has the replacement's offset
            offset = units[base] & 0x7FFFFFFF
            found[key.decode()] = texts[offset : texts.index(b"\0", offset)].decode()
        for byte in range(1, 256):
            to = base ^ byte
            if to < len(units) and units[to] & 0x800000FF == byte:
                waiting.append((to, key + bytes((byte,))))
    return found


def char_starts(text: str) -> np.ndarray:
    """The byte at which each character starts in UTF-8, and at last the number of bytes."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


class Normaliser:
    """text -> normalised text with ``MARK`` for spaces, and the source byte of each of its characters and of its end.

    ``prefix`` puts a mark in front, ``squeeze`` drops spaces at both ends and all but the first of a run.
    """

    def __init__(self, keys: dict[str, str], prefix: bool, squeeze: bool):
        if any(SPACES.search(x) for x in keys.values()):
            raise ValueError("a replacement with two spaces in a row is not supported")
        self._keys, self._prefix, self._squeeze = keys, prefix, squeeze
        lengths: dict[str, set[int]] = {}
        for key in keys:
            lengths.setdefault(key[0], set()).add(len(key))
        self._lengths = {first: sorted(found, reverse=True) for first, found in lengths.items()}
        self._first = re.compile(f"[{''.join(map(re.escape, sorted(lengths)))}]") if lengths else None

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        starts = char_starts(text)
        if self._first is None or not self._first.search(text):
            return text, starts
        parts, places, done = [], [], 0
        for hit in self._first.finditer(text):
            at = hit.start()
            if at < done:  # inside a longer key
                continue
            longest = next((n for n in self._lengths[text[at]] if at + n <= len(text) and text[at : at + n] in self._keys), 0)
            if longest:
                new = self._keys[text[at : at + longest]]
                parts += (text[done:at], new)
                places += (starts[done:at], np.full(len(new), starts[at]))
                done = at + longest
        return "".join([*parts, text[done:]]), np.concatenate([*places, starts[done:]])

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        if not text:
            return "", np.zeros(1, np.int64)
        found, places = self._mapped(text)
        front = 0
        if self._squeeze:
            blank = np.frombuffer(found.encode("utf-32-le"), "<u4") == 32
            sources = char_starts(text)
            while front < sources[-1] and front < len(blank) and blank[front] and places[front] == sources[front] < places[front + 1]:
                front += 1  # spaces, each by itself, before all else
            front = sources[front]
            keep = ~(blank & np.append(True, blank[:-1]))
            found = "".join(np.array(list(found), object)[keep]) if keep.any() else ""
            places = places[np.append(keep, True)]
            if not found and front == sources[-1]:
                return "", np.zeros(1, np.int64)
        if self._prefix:
            found, places = " " + found, np.append(front, places)
        if self._squeeze and len(short := found.rstrip(f" {MARK}")) < len(found):
            found, places = short, places[: len(short) + 1]
        return found.replace(" ", MARK), places
