"""Exact byte-level BPE ids with a bounded cache per Python worker."""

from __future__ import annotations

import base64
import functools
import re

#: Fixed value: the pre-tokenisation pattern of this family of public vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters that the pattern's \s stands for (Unicode White_Space).
WHITE = "\t\n\v\f\r \x85\xa0                　"
CACHE_PIECES = 400_000
CACHE_LENGTH = 48


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; looked up on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceCache(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit bytes; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = b"".join(i.to_bytes(4, "little") for i in self._encode(piece))
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = found
        return found


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str):
    """text -> ids as bytes, equal to what the byte-level tokenizer with this vocabulary gives for the whole text.

    ``path`` is a file of ranks. No pre-token of PATTERN goes on from a character that is not white space to one
    that is, so a text can be cut there and the cuts, which repeat, encoded one by one. Strings of special tokens
    in a text are ordinary text.
    """
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
    cache = PieceCache(encoding.encode_ordinary)
    return lambda text: b"".join(map(cache.__getitem__, cut(text)))
