"""Sets of word shingles of whole texts, worked out for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
U = np.uint64
BASE = 0x9E3779B97F4A7C15
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 512
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings at start, eight bytes a step: none of up to eight bytes share one."""
    eights = np.lib.stride_tricks.sliding_window_view(np.append(flat, np.zeros(8, dtype=np.uint8)), 8)
    out = mix(length.astype(U) * U(BASE) + U(1))
    going, done = np.flatnonzero(length <= LONG_WORD), 0
    while len(going):
        block = np.ascontiguousarray(eights[start[going] + done]).view("<u8").ravel()
        left = length[going] - done
        out[going] = mix((out[going] + U(done)) ^ (block & FIRST_BYTES[np.minimum(left, 8)]))
        going, done = going[left > 8], done + 8
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(flat[start[i] : start[i] + length[i]].tobytes(), digest_size=8).digest()
        out[i] = U(int.from_bytes(digest, "little"))
    return out


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of all texts, in that order; hashes are 64 bits.

    A-Z are lower-cased, words lie between ASCII white space; a text of fewer than WORDS words has one shingle.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(LOWER) + b" " for t in texts]
    flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
    space = IS_SPACE[flat]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    end = np.flatnonzero(space & np.append(False, ~space[:-1]))
    if not len(start):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    word = word_hashes(flat, start, end - start)
    text = np.searchsorted(np.cumsum([len(r) for r in raw]), start, side="right")
    n_words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    place = np.arange(len(word)) - first[text]
    lacking = n_words[text] - place  # words from here to the text's end
    hashed = np.zeros(len(word), dtype=U)
    padded = np.concatenate([word, np.zeros(WORDS, dtype=U)])
    for k in range(WORDS):
        hashed = mix(hashed * U(BASE) + np.where(k < lacking, padded[k : k + len(word)], U(k + 1)))
    whole = (lacking >= WORDS) | (place == 0)
    text, hashed = text[whole], hashed[whole]
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    distinct = np.append(True, (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1]))
    return text[distinct], hashed[distinct]
