"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts with one state and a loop for each byte. Merges are put in
one after the other, each by a gadget: for the merge of a and b into c, the
state that arcs labelled a lead to is copied without its arc labelled b, arcs
labelled a are led to the copy, and wherever an arc a could be followed by an
arc b there is now an arc c to where that arc b led. Afterwards a sequence of
tokens is a path if and only if it is the encoding of the bytes it spells.

Arcs with the same label always lead to the same state, so a state is known by
the token just read. What a gadget does to the whole automaton is one rectangle:
it takes the arc b, and with it those that came from it by later merges (tokens
that begin with b up to then), from the state a and from those that were copied
from it by later merges (tokens that end with a up to then). Where tokens are
numbered in preorder of the trees of their left parts, later merges first, the
labels are an interval, and so are the states in the trees of right parts. The
compiled table has, for each state, the intervals of labels without an arc; states
with equal intervals share a row. A transition is one lookup in it.

An encoding is found in one pass over a word: for each prefix, the last token is
the longest token ending there (an automaton of suffixes gives them, longest
first) that has an arc from the state of what is before it. There is exactly one.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Sequence

import numpy as np

#: The pattern that splits texts into words, of the public byte-level vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of a token's number in the keys of the table.
SHIFT = 20


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself where
    it is printable, else the next unused one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(other)}


def read_merges(path: str) -> tuple[list[bytes | None], list[tuple[int, int, int]]]:
    """Tokens by id (None for special ones) and the merges (a, b, c) in order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte = byte_symbols()
    vocab: dict[str, int] = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    used = {a + b for a, b in merges} | set(byte)
    tokens: list[bytes | None] = [None] * (max(vocab.values()) + 1)
    for t, n in vocab.items():
        if t in used:
            tokens[n] = bytes(byte[x] for x in t)
    return tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]


class _Tree:
    """Tokens under the part that they were merged from, later merges first."""

    def __init__(self, n: int):
        self.under: list[list[int]] = [[] for _ in range(n)]
        self.time = [-1] * n

    def add(self, token: int, part: int, time: int) -> None:
        self.under[part].append(token)
        self.time[token] = time

    def number(self) -> None:
        """Preorder: `order` of tokens, `place` of each and the end of what is under it."""
        n = len(self.under)
        self.order: list[int] = []
        self.place, self.end = np.zeros(n, np.int64), [0] * n
        todo = [t for t in range(n - 1, -1, -1) if self.time[t] < 0]
        while todo:
            t = todo.pop()
            if t < 0:
                self.end[~t] = len(self.order)
                continue
            self.place[t] = len(self.order)
            self.order.append(t)
            todo.append(~t)
            todo += self.under[t]  # in order of time; the last comes first

    def since(self, token: int, time: int) -> tuple[int, int]:
        """The places of a token and of what was merged from it at that time or later."""
        at = int(self.place[token])
        end = at + 1
        for c in reversed(self.under[token]):
            if self.time[c] < time:
                break
            end = self.end[c]
        return at, end


class Automaton:
    """The compiled tables: small arrays, made once and sent to every task."""

    def __init__(self, tokens: Sequence[bytes | None], merges: Iterable[tuple[int, int, int]]):
        n = len(tokens)
        if n >= 1 << SHIFT:
            raise ValueError("a vocabulary may have at most 2**20 - 1 tokens")
        self.n_bytes = np.array([len(t or b"") for t in tokens], np.int32)
        self.label_at = np.r_[0, np.cumsum(self.n_bytes)].astype(np.int64)
        self.labels = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        merges = list(merges)
        self._arcs(n, merges)
        self._suffixes([t if ok else None for t, ok in zip(tokens, self._spelt(n, merges))])
        self._ready = None

    def _arcs(self, n: int, merges: list[tuple[int, int, int]]) -> None:
        """The table: of each token its row and its place among the labels, and of all
        rows the intervals of labels without an arc, as sorted keys."""
        starts, ends = _Tree(n), _Tree(n)  # by left and by right part
        for k, (a, b, c) in enumerate(merges):
            starts.add(c, a, k)
            ends.add(c, b, k)
        starts.number()
        ends.number()
        # the gadget's own token c has no part in it: in the tree of left parts it counts as
        # earlier than itself, since in a row of merges of one time the leftmost is made first
        states = np.array([ends.since(a, k + 1) for k, (a, _, _) in enumerate(merges)], np.int64).reshape(-1, 2)
        labels = np.array([starts.since(b, k) for k, (_, b, _) in enumerate(merges)], np.int64).reshape(-1, 2)
        # the intervals of all states at once, in order of state and begin; those that touch are made one
        n_of = states[:, 1] - states[:, 0]
        state = np.repeat(states[:, 0] - np.r_[0, np.cumsum(n_of)[:-1]], n_of) + np.arange(n_of.sum())
        gaps = np.repeat(labels, n_of, axis=0) + (state << SHIFT)[:, None]
        gaps = gaps[np.argsort(gaps[:, 0], kind="stable")]
        reach = np.maximum.accumulate(gaps[:, 1])
        new = np.flatnonzero(np.r_[True, gaps[1:, 0] > reach[:-1]]) if len(gaps) else np.empty(0, np.int64)
        lo, hi = gaps[new, 0], reach[np.r_[new[1:], len(gaps)] - 1] if len(gaps) else new
        cut = np.searchsorted(lo, np.arange(len(ends.order) + 1) << SHIFT)
        inside = np.c_[lo, hi] & ((1 << SHIFT) - 1)
        rows: dict[bytes, int] = {}
        kept: list[np.ndarray] = []
        self.row = np.zeros(n, np.int32)
        for token, x, z in zip(ends.order, cut[:-1].tolist(), cut[1:].tolist()):
            row = inside[x:z]
            no = rows.setdefault(row.tobytes(), len(rows))
            if no == len(kept):
                kept.append(row + (no << SHIFT))
            self.row[token] = no
        table = np.concatenate(kept) if kept else inside
        self.no_arc, self.until = table[:, 0].copy(), table[:, 1].copy()
        self.place = starts.place.astype(np.int32)

    def has_arc(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether token b may come after token a, for arrays of tokens: one lookup each."""
        key = (self.row[a].astype(np.int64) << SHIFT) + self.place[b]
        if not len(self.no_arc):
            return np.ones(len(key), bool)
        at = np.searchsorted(self.no_arc, key, side="right") - 1
        return (at < 0) | (key >= self.until[at])

    def _spelt(self, n: int, merges: list[tuple[int, int, int]]) -> list[bool]:
        """Which tokens are the encoding of their own bytes. Of trained vocabularies
        all are; others, whose bytes earlier merges pull apart, are never made: those
        between whose parts an earlier gadget has taken the arc."""
        first: dict[tuple[int, int], int] = {}
        part: dict[int, tuple[int, int, int]] = {}
        ok = [True] * n
        for k, (a, b, c) in enumerate(merges):
            # the tokens at the seam as they were before time k, from the last on
            x, y, before, fine = a, b, k, True
            while fine:
                fine = first.get((x, y), before) >= before
                tx, ty = (part[z][2] if z in part else -1 for z in (x, y))
                if tx < 0 and ty < 0:
                    break
                if tx > ty:
                    x, before = part[x][1], tx
                else:
                    y, before = part[y][0], ty + 1
            ok[c] = fine and ok[a] and ok[b]
            first.setdefault((a, b), k)
            part[c] = a, b, k
        return ok

    def _suffixes(self, tokens: Sequence[bytes | None]) -> None:
        """The automaton of suffixes: a trie of all tokens with failure links."""
        arcs: list[dict[int, int]] = [{}]
        end = [-1]
        for n, t in enumerate(tokens):
            if not t:
                continue
            at = 0
            for x in t:
                nxt = arcs[at].get(x)
                if nxt is None:
                    nxt = arcs[at][x] = len(arcs)
                    arcs.append({})
                    end.append(-1)
                at = nxt
            end[at] = n
        fail, longest = [0] * len(arcs), end[:]
        shorter = np.full(len(tokens), -1, np.int32)
        order, todo = [], deque([0])
        while todo:
            at = todo.popleft()
            order.append(at)
            for x, nxt in arcs[at].items():
                f = fail[at]
                while f and x not in arcs[f]:
                    f = fail[f]
                fail[nxt] = arcs[f][x] if at and x in arcs[f] else 0
                if end[nxt] >= 0:
                    shorter[end[nxt]] = longest[fail[nxt]]
                else:
                    longest[nxt] = longest[fail[nxt]]
                todo.append(nxt)
        self.order = np.array(order, np.int32)
        self.fail, self.longest, self.shorter = np.array(fail, np.int32), np.array(longest, np.int32), shorter
        self.arc_from = np.array([a for a, d in enumerate(arcs) for _ in d], np.int32)
        self.arc_byte = np.array([x for d in arcs for x in d], np.uint8)
        self.arc_to = np.array([t for d in arcs for t in d.values()], np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": None}

    def ready(self) -> Encoder:
        """The encoder of this process, made at first use."""
        if self._ready is None:
            self._ready = Encoder(self)
        return self._ready


class Encoder:
    """An automaton with the tables and the cache of words of one process."""

    #: Words that are remembered, and bytes of new words at once.
    MOST_WORDS, AT_ONCE = 300_000, 1 << 20

    def __init__(self, a: Automaton):
        import regex

        self.a = a
        self.find = regex.compile(WORDS).findall
        self.finder = regex.compile(WORDS).finditer
        kind = np.uint16 if len(a.fail) < 1 << 16 else np.int32
        self.goto = np.zeros((len(a.fail), 256), kind)
        cut = np.argsort(a.arc_from, kind="stable")
        f, x, t = a.arc_from[cut], a.arc_byte[cut], a.arc_to[cut]
        depth = np.zeros(len(a.fail), np.int32)
        for at in range(0, 1 << 30):
            nodes = np.flatnonzero(depth == at)
            if not len(nodes):
                break
            if at:
                self.goto[nodes] = self.goto[a.fail[nodes]]
            own = depth[f] == at if at else f == 0
            self.goto[f[own], x[own]] = t[own]
            depth[t[own]] = at + 1
        self.forget()

    def forget(self) -> None:
        self.new: list[str] = []
        self.words = _Numbered(self.new)
        self.at = np.zeros(1, np.int64)
        self.n = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def encode_words(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of tokens, all tokens) of non-empty words, many at once."""
        n_of = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-n_of, kind="stable")
        counts = np.zeros(len(words), np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        a = 0
        while a < len(order):
            z = a + max(1, int(np.searchsorted(np.cumsum(n_of[order[a:]]), self.AT_ONCE)))
            some = order[a:z]
            counts[some], flat = self._block([words[i] for i in some], n_of[some])
            parts.append((some, flat))
            a = z
        at = np.r_[0, np.cumsum(counts, dtype=np.int64)]
        out = np.empty(at[-1], np.int32)
        for some, flat in parts:
            c = counts[some].astype(np.int64)
            out[np.repeat(at[some] - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(len(flat))] = flat
        return counts, out

    def _block(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.a
        text = np.frombuffer(b"".join(words), np.uint8)
        start = np.r_[0, np.cumsum(size)[:-1]]
        last = np.empty(len(text), np.int32)
        node = np.zeros(len(words), self.goto.dtype)
        active = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # words longer than i
        for i, m in enumerate(active.tolist()):
            node[:m] = self.goto[node[:m], text[start[:m] + i]]
            todo, token = np.arange(m), a.longest[node[:m]]
            while len(todo):
                if (token < 0).any():
                    raise ValueError("a text has bytes that no token spells")
                before = i - a.n_bytes[token]
                ok = before < 0
                inner = np.flatnonzero(~ok)
                if len(inner):
                    w = todo[inner]
                    ok[inner] = a.has_arc(last[start[w] + before[inner]], token[inner])
                done = todo[ok]
                last[start[done] + i] = token[ok]
                todo, token = todo[~ok], a.shorter[token[~ok]]
        # back from the ends of the words
        left, live = size.copy(), np.arange(len(words))
        counts, back = np.zeros(len(words), np.int32), []
        while len(live):
            t = last[start[live] + left[live] - 1]
            back.append((live, t))
            counts[live] += 1
            left[live] -= a.n_bytes[t]
            live = live[left[live] > 0]
        ends = np.cumsum(counts, dtype=np.int64)
        flat = np.empty(ends[-1], np.int32)
        for r, (w, t) in enumerate(back):
            flat[ends[w] - 1 - r] = t
        return counts, flat

    def _learn(self) -> None:
        """Encode the words that were seen for the first time."""
        if not self.new:
            return
        n, flat = self.encode_words([w.encode("utf-8", "surrogatepass") for w in self.new])
        self.at = np.r_[self.at, self.at[-1] + np.cumsum(n, dtype=np.int64)]
        self.n, self.pool = np.r_[self.n, n], np.r_[self.pool, flat]
        self.new.clear()

    def pieces(self, texts: Sequence[str | None], chars: int = 1 << 20) -> Iterable[tuple[list[str], list[int], bool]]:
        """Words of some texts at a time: (words, their number per text, whether
        the last text goes on in the next piece)."""
        words: list[str] = []
        per: list[int] = []
        size = 0
        for t in texts:
            t = t or ""
            if len(t) > 4 * chars:
                n = 0
                for m in self.finder(t):
                    words.append(m.group())
                    n += 1
                    if n >= chars // 2:
                        yield words, [*per, n], True
                        words, per, n, size = [], [], 0, 0
                per.append(n)
            else:
                found = self.find(t)
                words += found
                per.append(len(found))
            size += len(t)
            if size >= chars:
                yield words, per, False
                words, per, size = [], [], 0
        if per:
            yield words, per, False

    def encode(self, texts: Sequence[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each text, all tokens one after the other).
        Null and empty texts have none. Without ids, only the numbers."""
        counts: list[np.ndarray] = []
        out: list[np.ndarray] = []
        more = 0
        for words, per, goes_on in self.pieces(texts):
            if len(self.words) > self.MOST_WORDS:
                self.forget()
            no = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
            self._learn()
            n = self.n[no].astype(np.int64)
            run = np.r_[0, np.cumsum(n)]
            ends = np.cumsum(per)
            c = run[ends] - run[np.r_[0, ends[:-1]]]
            c[0] += more
            more = int(c[-1]) if goes_on else 0
            counts.append(c[:-1] if goes_on else c)
            if ids:
                out.append(self.pool[np.repeat(self.at[no] - run[:-1], n) + np.arange(run[-1])])
        return (np.concatenate(counts) if counts else np.zeros(0, np.int64)), (np.concatenate(out) if out else np.zeros(0, np.int32))

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """The texts of lists of tokens, by the labels of the arcs they stand for.
        Bytes that aren't UTF-8 become U+FFFD; unknown ids have no label."""
        a = self.a
        ids = np.asarray(ids, np.int64)
        ids = np.where((ids >= 0) & (ids < len(a.n_bytes)), ids, -1)
        n = np.where(ids < 0, 0, a.n_bytes[ids]).astype(np.int64)
        run = np.r_[0, np.cumsum(n)]
        raw = a.labels[np.repeat(a.label_at[ids] - run[:-1], n) + np.arange(run[-1])].tobytes()
        cut = run[np.asarray(offsets, np.int64) - offsets[0]]
        return [raw[x:y].decode("utf-8", "replace") for x, y in zip(cut[:-1].tolist(), cut[1:].tolist())]


class _Numbered(dict):
    """Numbers of words; a word seen for the first time gets the next one."""

    def __init__(self, new: list[str]):
        self.new = new

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def compile_file(path: str) -> Automaton:
    return Automaton(*read_merges(path))
