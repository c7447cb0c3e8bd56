"""Windows of texts chosen by content, and count-min sketches that count them.

Of every window of `length` characters one gram of half that length stands for
it: that with the least hash, the leftmost of equals. It depends on the window's
characters alone, so two texts with a window in common have its gram, its anchor,
in common at the same place of the window, and a text has about one anchor for
every length / 4 characters instead of a window for each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters that are worked on at once; longer texts are cut into overlapping slices.
SLICE = 1 << 16
#: Counters stop here, and so do counts: more is only known to be many.
TOP = 15
ROWS = 3
LEAST_WIDTH = 1 << 10

_U = np.uint64
_ALL = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that scatters them."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Roller:
    """Hashes of all windows of a slice, from sums of character hashes times
    powers of an odd number, modulo 2**64. For windows far below 1024 characters
    no two contents collide other than by chance."""

    def __init__(self, seed: int, most: int):
        base = (0x9E3779B97F4A7C15 + 2 * seed) | 1
        self.seed = _U(seed * 0x632BE59BD9B4E019 & _ALL)
        self.power = np.cumprod(np.r_[_U(1), np.full(most, base, np.uint64)])
        self.inverse = np.cumprod(np.r_[_U(1), np.full(most, pow(base, -1, 1 << 64), np.uint64)])
        self.table = mix(np.arange(1 << 16, dtype=np.uint64) + _U(1) + self.seed)

    def sums(self, codes: np.ndarray) -> np.ndarray:
        c = self.table[codes & 0xFFFF]
        high = np.flatnonzero(codes > 0xFFFF)
        if len(high):
            c[high] = mix(codes[high].astype(np.uint64) + _U(1) + self.seed)
        return np.r_[_U(0), np.cumsum(c * self.power[: len(codes)])]

    def hashes(self, sums: np.ndarray, at: np.ndarray | slice, size: int) -> np.ndarray:
        """Of the windows of `size` characters that begin at the given places."""
        if isinstance(at, slice):
            n = len(sums) - size
            return mix((sums[size:] - sums[:n]) * self.inverse[:n])
        return mix((sums[at + size] - sums[at]) * self.inverse[at])


class Slice:
    """Some texts or a part of one: where windows begin and what stands for them.

    doc, begin: of each valid window, the text's number and its place in it.
    pick: the place in `codes` of the gram that stands for it; gram: its hash."""

    def __init__(self, parts: list[tuple[int, int, str]], length: int, roll: Roller):
        self.length, self.k = length, length // 2
        self.codes = np.frombuffer("".join(p[2] for p in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        self.sums = roll.sums(self.codes)
        n = len(self.codes) - length + 1
        gram = roll.hashes(self.sums, slice(None), self.k)
        place = np.arange(len(gram), dtype=np.uint64)
        key = (gram & ~_U((1 << 20) - 1)) | place
        span, want = 1, length - self.k + 1
        while span < want:
            s = min(span, want - span)
            key = np.minimum(key[:-s], key[s:])
            span += s
        # windows that begin early enough in their text
        valid = np.ones(n, bool)
        for e in ends[:-1].tolist():
            valid[max(0, e - length + 1) : e] = False
        self.at = np.flatnonzero(valid)
        self.pick = (key[self.at] & _U((1 << 20) - 1)).astype(np.int64)
        self.gram = gram[self.pick]
        self._all = gram
        starts = ends - sizes
        self.part_end = ends
        self.part_doc = np.array([p[0] for p in parts])
        self.part_shift = np.array([p[1] for p in parts]) - starts

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place in it) of places in codes."""
        part = np.searchsorted(self.part_end, at, side="right")
        return self.part_doc[part], at + self.part_shift[part]

    def anchors(self) -> np.ndarray:
        """The places in codes of distinct grams that stand for windows. In a run of
        one character repeated, only its first and its last gram: windows that meet
        in the run meet at its beginning or at its end as well."""
        if not len(self.pick):
            return self.pick
        p = self.pick[np.r_[True, self.pick[1:] != self.pick[:-1]]]  # in order, as windows are
        c, k = self.codes, self.k
        at = np.flatnonzero((c[p] == c[p + k - 1]) & (c[p] == c[p + 1]) & (c[p] == c[p + k // 2]))
        if not len(at):
            return p
        begins = np.r_[True, c[1:] != c[:-1]]
        begins[self.part_end[:-1]] = True
        cut = np.flatnonzero(begins)
        run = np.searchsorted(cut, p[at], side="right") - 1
        end = np.r_[cut[1:], len(c)][run]
        inside = p[at] + k <= end
        out = np.sort(np.concatenate([np.delete(p, at[inside]), cut[run[inside]], end[inside] - k]))
        return out[np.r_[True, out[1:] != out[:-1]]]


def slices(texts: Sequence[str | None], length: int, roll: Roller) -> Iterator[Slice]:
    """The texts that have a window, some at a time."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for n, t in enumerate(texts):
        if t is None or len(t) < length:
            continue
        if len(t) > SLICE:
            for a in range(0, len(t) - length + 1, SLICE - length + 1):
                yield Slice([(n, a, t[a : a + SLICE])], length, roll)
            continue
        if size + len(t) > SLICE:
            yield Slice(held, length, roll)
            held, size = [], 0
        held.append((n, 0, t))
        size += len(t)
    if held:
        yield Slice(held, length, roll)


class Sketch:
    """A count-min sketch with counters up to TOP: an estimate is never below the
    true count, or is TOP. What parts of the data add is summed."""

    def __init__(self, width: int):
        self.width = width
        self.cells = np.zeros((ROWS, width), np.uint8)

    def _at(self, keys: np.ndarray) -> list[np.ndarray]:
        return [((mix(keys + _U(r * 0x9E3779B97F4A7C15 & _ALL))) & _U(self.width - 1)).astype(np.int64) for r in range(ROWS)]

    def add(self, keys: np.ndarray, times: int = 1) -> None:
        for r, at in enumerate(self._at(keys)):
            n = np.minimum(np.bincount(at, minlength=self.width), TOP) * min(times, TOP)
            self.cells[r] = np.minimum(self.cells[r] + n, TOP)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), TOP, np.uint8)
        for r, at in enumerate(self._at(keys)):
            out = np.minimum(out, self.cells[r, at])
        return out


def width_for(keys: int) -> int:
    """Counters of a row, a power of two: two to four for each key, so that one key
    in fifteen to a hundred passes by chance."""
    return max(LEAST_WIDTH, 1 << (2 * keys - 1).bit_length() if keys else 0)
