"""Byte-level BPE as a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

The transducer reads the bytes of one piece. The encoding of a prefix is a chain of tokens, and its
last token is the only one that ends there and is compatible with the token before it (the two, merged
on their own, stay two). The token that will cover the next byte starts at one of the places from which
the bytes read so far begin some token. What the chains to all those places share can no longer change:
it is emitted, after a look-ahead of one token's length at most. A state is what is left: the last
emitted token and the bytes after it. States and their transitions are made when first met and kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.resident import enter, resident
from siltstone.llm.textbytes import pieces

TRANSITIONS = 400_000  # kept at most from one batch of pieces to the next
CACHED = 150_000  # pieces, and stretches, kept at most from one batch of texts to the next
PIECES_AT_ONCE = 100_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int], halves: bool = False) -> list[int]:
    """The definition: again and again merge the leftmost pair of the lowest rank; with ``halves``, until two are left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 62
    pairs = [get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while len(pairs) > halves:
        low = min(pairs)
        if low == none:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


class IntMap:
    """From 64-bit keys (not negative) to 32-bit numbers, many at once; -1 for keys that are not in it."""

    def __init__(self, bits: int = 12):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at, mask = self._slot(keys), len(self.keys) - 1
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], np.int32(-1))
        live = np.flatnonzero(~hit & (found >= 0))
        while len(live):
            at[live] = here = at[live] + 1 & mask
            found, wanted = self.keys[here], keys[live]
            hit = found == wanted
            out[live[hit]] = self.values[here[hit]]
            live = live[~hit & (found >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that are all different and not in it yet."""
        if (self.n + len(keys)) * 3 > len(self.keys):
            old = self.keys >= 0
            k, v = self.keys[old], self.values[old]
            self.__init__(max(self.bits + 1, int((self.n + len(keys)) * 4).bit_length()))
            self.put(k, v)
        self.n += len(keys)
        at, mask, live = self._slot(keys), len(self.keys) - 1, np.arange(len(keys))
        while len(live):
            free = live[self.keys[at[live]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for one slot one gets it
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            live = live[self.keys[at[live]] != keys[live]]
            at[live] = at[live] + 1 & mask


class Pool:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.n, self.a = 0, np.zeros(1024, kind)

    def add(self, values: np.ndarray) -> int:
        """Where they begin."""
        at, self.n = self.n, self.n + len(values)
        if self.n > len(self.a):
            self.a = np.concatenate([self.a, np.zeros(max(len(self.a), len(values)), self.a.dtype)])
        self.a[at : self.n] = values
        return at


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each start, so many of each."""
    return np.arange(int(n.sum())) + np.repeat(start - np.cumsum(n) + n, n)


def _columns(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all entries of rows with so many each."""
    return np.repeat(np.arange(len(n)), n), _ranges(np.zeros(len(n), np.int64), n)


class Transducer:
    """Turns the bytes of pieces into token ids, many pieces in step with one another.

    A state knows its tail (the bytes after the last emitted token) and, for each place in it, the last
    token that ends there and where that starts; and the places from which the tail begins some token,
    each with its node in the tree of all tokens. All that lies in flat arrays. ``_step`` makes the
    transitions that a batch meets for the first time, all at once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.bytes_of = ranks, {i: b for b, i in ranks.items()}
        size = max(ranks.values()) + 1
        # The tree of all tokens.
        children: dict[int, int] = {}
        token, opened = [-1], [True]
        joined: dict[int, int] = {}
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        for data, i in ranks.items():
            node = 0
            for byte in data:
                opened[node] = True
                key = node << 8 | byte
                node = children.get(key, -1)
                if node < 0:
                    node = children[key] = len(token)
                    token.append(-1)
                    opened.append(False)
            for k in range(1, len(data)):
                x = ranks.get(data[:k])
                y = ranks.get(data[k:]) if x is not None else None
                if y is not None:
                    joined[x << 24 | y] = i
            if len(data) > 1:
                # The two tokens whose merge makes this one; a token that its bytes do not merge into is never used.
                parts = merge(data, ranks, halves=True)
                if len(parts) != 2:
                    continue
                self.left[i], self.right[i] = parts
            token[node] = i
        self.token, self.opened = np.array(token, np.int64), np.array(opened)
        self.children, self.joined = IntMap(), IntMap()
        for table, entries in ((self.children, children), (self.joined, joined)):
            table.put(np.fromiter(entries, np.int64, len(entries)), np.fromiter(entries.values(), np.int32, len(entries)))
        self.heads = self.children.get(np.arange(256))
        self.reset()

    def reset(self) -> None:
        """Forget all states but the first."""
        self.pairs = IntMap(16)
        self.names, self.transitions = IntMap(16), IntMap(16)
        #: The state of each name; a name is a last token (number 0 is none) or another name and one more byte.
        self.state_of = Pool(np.int32)
        self.state_of.add(np.full(len(self.left) + 1, -1, np.int32))
        self.before, self.at, self.size, self.live_at, self.live = (Pool(np.int64) for _ in range(5))
        self.tail, self.last, self.from_, self.live_from, self.live_node = Pool(np.uint8), Pool(np.int32), Pool(np.int16), Pool(np.int16), Pool(np.int32)
        self.next, self.out_at, self.out_n, self.out = Pool(np.int64), Pool(np.int64), Pool(np.int64), Pool(np.int32)
        for pool, value in ((self.before, -1), (self.at, 0), (self.size, 0), (self.live_at, 0), (self.live, 0)):
            pool.add(np.array([value]))
        self.state_of.a[0] = 0

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of both together merge into just these two.

        Merges happen by rising rank. Taken back one by one, the last first, they show which two tokens
        met at the border meanwhile: had those a merge of lower rank than what came next, it would have
        crossed the border. Of equal ranks the left one goes first.
        """
        key = a << 24 | b
        known = self.pairs.get(key)
        new = np.unique(key[known < 0])
        if len(new):
            x, y = new >> 24, new & 0xFFFFFF
            good = self.joined.get(new) < 0
            left, right = self.left, self.right
            open_ = np.flatnonzero(good & ((left[x] >= 0) | (left[y] >= 0)))
            while len(open_):
                p, q = x[open_], y[open_]
                back_a = (left[q] < 0) | (left[p] >= 0) & (p > q)
                limit = np.where(back_a, p, q + 1)
                x[open_] = p = np.where(back_a, right[p], p)
                y[open_] = q = np.where(back_a, q, left[q])
                crossing = self.joined.get(p << 24 | q)
                good[open_] = fine = (crossing < 0) | (crossing >= limit)
                open_ = open_[fine & ((left[p] >= 0) | (left[q] >= 0))]
            self.pairs.put(new, good.astype(np.int32))
            known = self.pairs.get(key)
        return known > 0

    def _name(self, names: np.ndarray, tails: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The names of last tokens followed by these bytes."""
        for t in range(int(n.max(initial=0))):
            rows = np.flatnonzero(n > t)
            key = names[rows] << 8 | tails[rows, start[rows] + t]
            new = np.unique(key[self.names.get(key) < 0])
            if len(new):
                at = self.state_of.add(np.full(len(new), -1, np.int32))
                self.names.put(new, np.arange(at, at + len(new), dtype=np.int32))
            names[rows] = self.names.get(key)
        return names

    def _step(self, states: np.ndarray, bytes_: np.ndarray) -> None:
        """Make the transitions from these states by these bytes."""
        rows = np.arange(len(states))
        m, before = self.size.a[states], self.before.a[states]
        last, from_, tail = (np.full((len(rows), int(m.max()) + 1), x, np.int64) for x in (-1, 0, 0))
        r, c = _columns(m)
        at = _ranges(self.at.a[states], m)
        last[r, c], from_[r, c], tail[r, c] = self.last.a[at], self.from_.a[at], self.tail.a[at]
        tail[rows, m] = bytes_
        # The places that the new byte goes on from, the farthest first, and the place of the byte itself.
        k = self.live.a[states]
        start, node = np.zeros((len(rows), int(k.max()) + 1), np.int64), np.full((len(rows), int(k.max()) + 1), -1, np.int64)
        r, c = _columns(k)
        at = _ranges(self.live_at.a[states], k)
        start[r, c] = self.live_from.a[at]
        node[r, c] = self.children.get(self.live_node.a[at].astype(np.int64) << 8 | bytes_[r])
        start[rows, k], node[rows, k] = m, self.heads[bytes_]
        # The only token that ends here and is compatible with the one before it.
        candidates = np.where(node >= 0, self.token[node], -1)
        token, since = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        for j in range(node.shape[1]):
            x = np.flatnonzero((token < 0) & (candidates[:, j] >= 0))
            s = start[x, j]
            left = np.where(s > 0, last[x, s - 1], before[x])
            good = left < 0
            inner = np.flatnonzero(~good)
            good[inner] = self._compatible(left[inner], candidates[x[inner], j])
            x = x[good]
            token[x], since[x] = candidates[x, j], start[x, j]
        last[rows, m], from_[rows, m] = token, since
        # Back along the chains from all places where the next token may start, to where they meet.
        live = (node >= 0) & self.opened[node]
        cut = m + 1
        for j in range(node.shape[1]):
            x = np.flatnonzero(live[:, j])
            place, c = start[x, j], cut[x]
            while (apart := np.flatnonzero(c != place)).size:
                far, near = apart[c[apart] > place[apart]], apart[c[apart] < place[apart]]
                c[far] = from_[x[far], c[far] - 1]
                place[near] = from_[x[near], place[near] - 1]
            cut[x] = c
        out, out_n = self._chains(last, from_, cut)
        before = np.where(cut > 0, last[rows, cut - 1], before)
        n = m + 1 - cut
        names = self._name(before + 1, tail, cut, n)
        new, first = np.unique(names, return_index=True)
        first = first[self.state_of.a[new] < 0]
        if len(first):
            at = self.before.add(before[first])
            self.state_of.a[names[first]] = np.arange(at, at + len(first))
            c, k = n[first], live[first].sum(axis=1)
            r = np.repeat(first, c)
            columns = _ranges(cut[first], c)
            start_at = self.last.add(last[r, columns])
            self.from_.add(np.maximum(from_[r, columns] - cut[r], 0))
            self.tail.add(tail[r, columns])
            self.at.add(start_at + np.cumsum(c) - c)
            self.size.add(c)
            r, columns = np.nonzero(live[first])
            live_at = self.live_from.add(start[first[r], columns] - cut[first[r]])
            self.live_node.add(node[first[r], columns])
            self.live_at.add(live_at + np.cumsum(k) - k)
            self.live.add(k)
        at = self.next.add(self.state_of.a[names])
        out_at = self.out.add(out)
        self.out_at.add(out_at + np.cumsum(out_n) - out_n)
        self.out_n.add(out_n)
        self.transitions.put(states << 8 | bytes_, np.arange(at, at + len(rows), dtype=np.int32))

    @staticmethod
    def _chains(last: np.ndarray, from_: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each row's chain up to its end, behind one another, and how many each row has."""
        end, n, found = end.copy(), np.zeros(len(end), np.int64), []
        while (x := np.flatnonzero(end > 0)).size:
            found.append((x, last[x, end[x] - 1], n[x]))
            n[x] += 1
            end[x] = from_[x, end[x] - 1]
        out, stop = np.zeros(int(n.sum()), np.int64), np.cumsum(n)
        for x, token, back in found:
            out[stop[x] - 1 - back] = token
        return out, n

    def encode(self, pieces_: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces behind one another, and how many each piece has."""
        if self.next.n > TRANSITIONS:
            self.reset()
        size = np.fromiter(map(len, pieces_), np.int64, len(pieces_))
        order = np.argsort(-size, kind="stable")
        start, size = (np.cumsum(size) - size)[order], size[order]
        data = np.frombuffer(b"".join(pieces_), np.uint8)
        state, made, n = np.zeros(len(size), np.int64), [], np.zeros(len(size), np.int64)
        ends = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")  # pieces that are so long
        for i, k in enumerate(ends.tolist()):
            key = state[:k] << 8 | data[start[:k] + i]
            t = self.transitions.get(key)
            new = np.flatnonzero(t < 0)
            if len(new):
                unseen = np.unique(key[new])
                self._step(unseen >> 8, unseen & 0xFF)
                t[new] = self.transitions.get(key[new])
            state[:k] = self.next.a[t]
            x = np.flatnonzero(self.out_n.a[t])
            if len(x):
                made.append((x, self.out_at.a[t[x]], self.out_n.a[t[x]], n[x]))
                n[x] += made[-1][2]
        m = self.size.a[state]
        last, from_ = (np.zeros((len(size), int(m.max(initial=0)) + 1), np.int64) for _ in range(2))
        r, c = _columns(m)
        at = _ranges(self.at.a[state], m)
        last[r, c], from_[r, c] = self.last.a[at], self.from_.a[at]
        rest, rest_n = self._chains(last, from_, m)
        counts = np.empty(len(size), np.int64)
        counts[order] = n + rest_n
        begin = (np.cumsum(counts) - counts)[order]
        out = np.empty(int(counts.sum()), np.int64)
        for x, out_at, out_n, so_far in made:
            out[_ranges(begin[x] + so_far, out_n)] = self.out.a[_ranges(out_at, out_n)]
        out[_ranges(begin + n, rest_n)] = rest
        return out, counts


class Utf8Machine:
    """Decodes token by token. A state is the start of an unfinished character; what a token does in a state is kept."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    @staticmethod
    def _need(lead: int) -> int:
        """Bytes of the character that this byte begins; 0 if none."""
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    def _move(self, held: bytes, token: int) -> tuple[str, bytes]:
        data, out, i = held + self.bytes_of[token], [], 0
        while i < len(data):
            need = self._need(data[i])
            part = data[i : i + need]
            if need and len(part) < need and all(0x80 <= b < 0xC0 for b in part[1:]):
                break
            try:
                out.append(part.decode() if need else "�")
                i += max(need, 1)
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        if len(self.moves) > 4096:
            self.moves = {b"": {}}
        got = self.moves.setdefault(held, {})[token] = "".join(out), data[i:]
        return got

    def stream(self, ids):
        """The text of each token, as far as its characters are complete."""
        held = b""
        for token in ids:
            text, held = self.moves.get(held, {}).get(token) or self._move(held, token)
            yield text
        if held:
            yield "�"

    def decode(self, ids) -> str:
        """The text of all tokens."""
        out, held, plain = [], b"", self.moves[b""]
        for token in ids:
            if held:
                text, held = self.moves.get(held, {}).get(token) or self._move(held, token)
                plain = self.moves[b""]
            else:
                text, held = plain.get(token) or self._move(held, token)
            out.append(text)
        if held:
            out.append("�")
        return "".join(out)


class Codec:
    """Encodes and decodes whole texts, many at once. Stretches between single spaces are looked up once."""

    # A space beside other white space: there the pattern looks past the space.
    _WIDE = re.compile(r"\s\s")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        #: Whether the pattern takes a space and the letters after it as one piece.
        self.words_whole = all(self.find(" " + w) == [" " + w] for w in ("a", "Zz", "sll", "qwertyuiopasdfghjklzxcvbnm"))
        self.transducer = Transducer(ranks)
        self.machine = Utf8Machine(self.transducer.bytes_of)
        self.decimal = {i: str(i) for i in self.transducer.bytes_of}.__getitem__
        # The ids as little-endian 32-bit numbers, of pieces and of stretches without the space before them.
        self.pieces: dict[str, bytes] = {}
        self.stretches: dict[str, bytes] = {}
        self.packed = {b: i.to_bytes(4, "little") for b, i in ranks.items()}

    def _split(self, text: str) -> tuple[list[str], list[str]]:
        """The pieces that a text begins with, and the stretches behind single spaces after them."""
        if self._WIDE.search(text) or text[:1].isspace() or text[-1:].isspace():
            return self.find(text), []
        # Each single space between other signs begins a piece.
        first, *rest = text.split(" ")
        return self.find(first), rest

    def _learn(self, split: list[tuple[list[str], list[str]]]) -> None:
        """Encode what is not known yet."""
        pieces_, stretches, new_pieces, new_stretches = self.pieces, self.stretches, set(), set()
        for known in (pieces_, stretches):
            if len(known) > CACHED:
                known.clear()
        for first, rest in split:
            new_pieces.update(set(first).difference(pieces_))
            new_stretches.update(set(rest).difference(stretches))
        # Most stretches are one piece; the others are cut into pieces first.
        whole = [p for p in new_stretches if p.isascii() and p.isalpha()] if self.words_whole else []
        cut = {p: self.find(" " + p) for p in new_stretches.difference(whole)}
        names = [" " + p for p in whole]
        number = dict(zip(names, range(len(names)), strict=True))
        for p in chain(new_pieces, *cut.values()):
            number.setdefault(p, len(number))
        data = [p.encode() for p in number]
        ids = list(map(self.packed.get, data))
        unknown = [k for k, i in enumerate(ids) if i is None]
        for at in range(0, len(unknown), PIECES_AT_ONCE):
            some = unknown[at : at + PIECES_AT_ONCE]
            tokens, counts = self.transducer.encode([data[k] for k in some])
            packed, stop = tokens.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            for k, lo, hi in zip(some, [0, *stop], stop, strict=False):
                ids[k] = packed[lo:hi]
        stretches.update(zip(whole, ids, strict=False))
        for p in new_pieces:
            pieces_[p] = ids[number[p]]
        for p, parts in cut.items():
            stretches[p] = b"".join([ids[number[x]] for x in parts])

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [self._split(t) for t in texts]
        self._learn(split)
        pieces_, stretches = self.pieces.__getitem__, self.stretches.__getitem__
        return [np.frombuffer(b"".join(chain(map(pieces_, first), map(stretches, rest))), "<u4").tolist() for first, rest in split]

    def decimals(self, ids: list[int]) -> str:
        """The ids in decimals, joined by commas."""
        return ",".join(map(self.decimal, ids))


def _codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def encode_decode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """The rows of ``docs`` with n_tokens, ids_sha256, decoded_text, decoded_sha256 (and ids).

    Defined cases: a null text is an empty one, with no tokens and an empty decoded text; very long texts are
    encoded whole, in slices of their own; a very long piece takes a step of the transducer for each byte;
    repeated rows get equal results; an empty table gives an empty result; other columns pass, but for those
    whose names clash with the new ones, which are replaced.
    """
    from pyspark.sql import types as T

    made = ["n_tokens", "ids_sha256", "decoded_text", "decoded_sha256"] + ["ids"] * ids
    kept = [c for c in docs.columns if c not in made]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in zip(made, [T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())], strict=False):
        schema = schema.add(name, kind)

    def run(batches):
        enter("byte_bpe")
        c = resident(_codec, ranks, pattern)
        sha = hashlib.sha256
        for b in pieces(batches, "__text", 1 << 21):
            n, digest, back, back_digest, lists = [], [], [], [], []
            for got in c.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()]):
                n.append(len(got))
                digest.append(sha(c.decimals(got).encode()).hexdigest())
                out = c.machine.decode(got)
                back.append(out)
                back_digest.append(sha(out.encode()).hexdigest())
                if ids:
                    lists.append(got)
            new = [pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string()), pa.array(back_digest, pa.string())] + [pa.array(lists, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [*kept, *made])

    return source.mapInArrow(run, schema)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
