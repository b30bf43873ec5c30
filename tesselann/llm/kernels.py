"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .subword import LOWER, MARKS, ODD

#: Bytes of texts taken at once; the arrays of a block then stay near the processor.
BLOCK = 1 << 16

A, B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on all bits of h."""
    h = (h ^ (h >> np.uint64(30))) * A
    h = (h ^ (h >> np.uint64(27))) * B
    return h ^ (h >> np.uint64(31))


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of ``raw`` begins, and its hash with A-Z lower-cased; a word is a run of ASCII letters, digits and
    bytes outside ASCII."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8)
    sep = MARKS[b]
    begins = np.nonzero(sep[:-1] & ~sep[1:])[0] + 1
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    word = np.cumsum(sep[:-1] & ~sep[1:]) - 1
    place = np.arange(len(b) - 1) - begins[np.maximum(word, 0)] + 1
    powers = ODD ** np.arange(256, dtype=np.uint64)
    place[sep[1:]] = 0
    value = (LOWER[b[1:]].astype(np.uint64) + np.uint64(1)) * powers[place & 255]
    value[sep[1:]] = 0
    return begins - 1, mixed(np.add.reduceat(value, begins - 1))


def word_hashes(text: str) -> np.ndarray:
    return words(text.encode())[1]


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words."""
    out = h[: max(0, len(h) - width + 1)]
    for k in range(1, width):
        out = mixed(out * ODD + h[k : k + len(out)])
    return out


def batches(texts: list[str | None], overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(which text, number of each word in it, hash)`` for blocks of texts, in order. A text over
    one block comes in several, each of which repeats the last ``overlap`` words of the text before it, however many blocks hold these."""
    own: list[int] = []
    raws: list[bytes] = []
    held = 0

    def flush():
        ends = np.cumsum([len(r) + 1 for r in raws])
        begins, h = words(b"\n".join(raws))
        which = np.searchsorted(ends, begins, "right")
        first = np.searchsorted(which, np.arange(len(raws)))
        return np.array(own)[which], np.arange(len(h)) - first[which], h

    for k, text in enumerate(texts):
        raw = (text or "").encode()
        if len(raw) < BLOCK:
            if held + len(raw) >= BLOCK:
                yield flush()
                own, raws, held = [], [], 0
            own, raws, held = [*own, k], [*raws, raw], held + len(raw) + 1
            continue
        at = base = end = 0
        while at < len(raw):
            end = min(len(raw), end + BLOCK)
            while end < len(raw) and not MARKS[raw[end]]:
                end += 1
            begins, h = words(raw[at:end])
            yield np.full(len(h), k), base + np.arange(len(h)), h
            if end == len(raw):
                break
            back = min(overlap, len(h))
            base += len(h) - back
            at = at + int(begins[-back]) if back else end
    if own:
        yield flush()


def whole(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(which text, hash)`` of words as from ``batches``, but a long text's words all come together."""
    long: list[np.ndarray] = []
    now = -1
    for which, _, h in batches(texts):
        many = len(h) > 0 and which[0] == which[-1]
        if long and not (many and which[0] == now):
            yield np.full(sum(map(len, long)), now), np.concatenate(long)
            long = []
        if many:
            now = int(which[0])
            long.append(h)
        elif len(h):
            yield which, h
    if long:
        yield np.full(sum(map(len, long)), now), np.concatenate(long)
