"""Token ids of texts with a public vocabulary file, through a bounded word cache.

Most words of a corpus repeat, and a word's ids do not depend on its neighbours:
the tokenizer drops white space. So each batch is split into words by Arrow, and
only words that the worker has not met lately are tokenised.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
# Pieces kept per generation; two generations are kept.
CACHED_PIECES = 400_000
# Bytes of one slice that is split at a time.
SLICE_BYTES = 8_000_000

# Words of these characters are lower-cased and cut here; all others, and those
# that could hold a special token, take the tokenizer's own way.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = r"('s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+)"
_PLAIN = re.compile(PLAIN)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _gather(flat: np.ndarray, size: np.ndarray, codes: np.ndarray):
    """Runs of ``flat`` (run i has ``size[i]`` values) in the order of ``codes``."""
    each = size[codes]
    ends = np.cumsum(each)
    shift = (np.cumsum(size) - size)[codes] - (ends - each)
    return flat[np.repeat(shift, each) + np.arange(len(flat) and int(each.sum()))], each


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths (0 for an empty run)."""
    at = np.concatenate(([0], np.cumsum(lengths)))
    return np.diff(np.concatenate(([0], np.cumsum(values)))[at])


class WordEncoder:
    """One per worker; holds the tokenizer and the pieces it has met lately."""

    def __init__(self, path: str | None = None, cached: int = CACHED_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.cached = cached
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        as_bytes = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.mapped = str.maketrans({c: as_bytes(c)[0][0] for c in letters})

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece as bytes of unsigned 32-bit integers."""
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                if _PLAIN.match(piece) and "<|" not in piece:
                    tokens = self.tokenizer.model.tokenize(
                        piece if piece.isascii() else piece.translate(self.mapped)
                    )
                    ids = [t.id for t in tokens]
                else:
                    ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
                got = array("I", ids).tobytes()
            if len(self.young) >= self.cached:
                self.young, self.old = {}, self.young
            self.young[piece] = got
        return got

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has (null: none)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        unique = coded.dictionary
        plain = pc.and_not(
            pc.match_substring_regex(unique, PLAIN), pc.match_substring(unique, "<|")
        )
        cut = pc.if_else(
            plain, pc.replace_substring_regex(pc.utf8_lower(unique), PIECES, r"\1 "), unique
        )
        cut = pc.ascii_split_whitespace(cut)
        pieces = cut.flatten().dictionary_encode()
        found = [self._piece(p) for p in pieces.dictionary.to_pylist()]
        flat = np.frombuffer(b"".join(found), np.uint32)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, each = _gather(flat, size, pieces.indices.to_numpy(zero_copy_only=False))
        size = _sums(each, pc.list_value_length(cut).to_numpy(zero_copy_only=False))
        flat, each = _gather(flat, size, coded.indices.to_numpy(zero_copy_only=False))
        return flat, _sums(each, pc.list_value_length(split).to_numpy(zero_copy_only=False))

    def documents(self, texts: pa.Array, end_id: int):
        """``(row, ids)`` of each text in order, its end id appended."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        parts = (np.cumsum(sizes, dtype=np.int64) - sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(texts)]
        for low, high in zip(cuts, cuts[1:]):
            ids, counts = self.encode(texts.slice(low, high - low))
            stop = 0
            for row, n in enumerate(counts.tolist(), low):
                start, stop = stop, stop + n
                yield row, np.append(ids[start:stop], np.uint32(end_id))


@lru_cache(maxsize=1)
def worker_encoder(path: str | None = None) -> WordEncoder:
    """The encoder of this Python worker, kept over its tasks.

    An encoder per task leaves several MB behind each time, which adds up where a
    worker runs many small tasks.
    """
    return WordEncoder(path)
