"""A byte-level BPE tokenizer compiled to two deterministic transducers that count tokens.

The first reads characters and marks where pre-tokens begin. It has few states,
so a chunk of text is a map from state to state; maps of all chunks are
computed side by side, composed by a parallel prefix scan, and give the state at which
each chunk starts. A second sweep over all chunks then reads off the marks.

The second reads the bytes of a pre-token. Its state is the node of a
suffix automaton over the vocabulary together with the tokens that end at the last
places: of all tokens that end here, exactly one goes with the token before it
(merging would never have cut across the border), and it is the last token of what was read. Its transitions
carry the number of tokens emitted so far. All distinct pre-tokens step through it side by side.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np

from riskmart.llm import words as W
from riskmart.llm.hashruns import HashRuns

# --- the first transducer: pre-tokens

LETTER, STMD, R, V, L, E, NUMBER, SPACE, BLANK, OTHER, QUOTE, RESET = range(12)
(START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, ONE_SPACE, SPACES, ONE_BLANK, BLANKS, AT_QUOTE, QUOTE_R, QUOTE_V, QUOTE_L, SHORT) = range(13)
STATES = 13
#: Marks: a pre-token begins at this character, at the one before.
HERE, BEFORE = 1, 2
#: Unicode's white space; fixed values.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CHUNK = 256


def symbol_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LN":
            table[point] = LETTER if kind == "L" else NUMBER
    table[list(WHITE)] = BLANK
    for letters, symbol in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        table[[ord(c) for c in letters]] = symbol
    return table


def compile_marks() -> tuple[np.ndarray, np.ndarray]:
    """(next state, marks) for state and symbol.

    Pre-tokens are: the short forms 's 't 'm 'd 're 've 'll where a quote
    begins one; runs of letters, of numbers, or of anything else that is no white
    space, each with one space before it; runs of white space, which leave
    their last character to what follows.
    """
    letters = {LETTER, STMD, R, V, L, E}
    solid = {**dict.fromkeys(letters, IN_LETTERS), NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    fresh = {**solid, SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AT_QUOTE}
    goes_on = {IN_LETTERS: letters, IN_NUMBERS: {NUMBER}, IN_OTHERS: {OTHER, QUOTE}}
    nexts, marks = np.zeros((STATES, 12), np.uint8), np.zeros((STATES, 12), np.uint8)

    def step(state: int, symbol: int) -> tuple[int, int]:
        if symbol == RESET:
            return START, BEFORE if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0
        if state in goes_on and symbol in goes_on[state]:
            return state, 0
        if state in (ONE_SPACE, SPACES, ONE_BLANK, BLANKS):
            if symbol in (SPACE, BLANK):
                return (SPACES if symbol == SPACE else BLANKS), 0
            joined = solid.get(symbol, IN_OTHERS)  # a quote behind a space begins a run of others
            if state in (ONE_SPACE, SPACES):
                return joined, BEFORE if state == SPACES else 0
            return fresh[symbol], HERE | (BEFORE if state == BLANKS else 0)
        if state == AT_QUOTE:
            if symbol == STMD:
                return SHORT, 0
            if symbol in (R, V, L):
                return {R: QUOTE_R, V: QUOTE_V, L: QUOTE_L}[symbol], 0
            if symbol in (OTHER, QUOTE):
                return IN_OTHERS, 0
        if state in (QUOTE_R, QUOTE_V, QUOTE_L):
            if symbol == (L if state == QUOTE_L else E):
                return SHORT, 0
            # No short form: the letter behind the quote began a run of letters.
            after, mark = step(IN_LETTERS, symbol)
            return after, mark | BEFORE
        return fresh[symbol], HERE

    for state in range(STATES):
        for symbol in range(12):
            nexts[state, symbol], marks[state, symbol] = step(state, symbol)
    return nexts, marks


_NEXT, _MARKS = compile_marks()


def chunk_maps(symbols: np.ndarray) -> np.ndarray:
    """For each chunk (row of symbols) the state it ends in from every state."""
    ends = np.tile(np.arange(STATES, dtype=np.uint8), (len(symbols), 1))
    for at in range(symbols.shape[1]):
        ends = _NEXT[ends, symbols[:, at, None]]
        # Most texts forget their past within a word or two: one state is left to follow.
        if at % 16 == 15 and (ends == ends[:, :1]).all():
            one = ends[:, 0]
            for rest in range(at + 1, symbols.shape[1]):
                one = _NEXT[one, symbols[:, rest]]
            return np.repeat(one[:, None], STATES, axis=1)
    return ends


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Composition of each map after all maps before it, in a logarithmic number of steps."""
    maps, step = maps.copy(), 1
    while step < len(maps):
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    return maps


def marks_of(symbols: np.ndarray) -> np.ndarray:
    """True at every symbol where a pre-token begins; the sequence starts in START."""
    size = len(symbols)
    rows = -(-size // CHUNK)
    padded = np.full(rows * CHUNK, RESET, np.uint8)
    padded[:size] = symbols
    padded = padded.reshape(rows, CHUNK)
    through = prefix_scan(chunk_maps(padded))
    state = np.full(rows, START, np.uint8)
    state[1:] = through[:-1, START]
    out = np.empty((rows, CHUNK), np.uint8)
    for at in range(CHUNK):
        symbol = padded[:, at]
        out[:, at] = _MARKS[state, symbol]
        state = _NEXT[state, symbol]
    flat = out.reshape(-1)
    begin = (flat & HERE) > 0
    begin[:-1] |= (flat[1:] & BEFORE) > 0
    return begin[:size]


# --- the second transducer: tokens of a pre-token


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: those that are so already, then from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for place, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + place)] = b
    return out


class BpeCounter:
    """Number of BPE tokens of byte strings. Tokens are numbered 0-255 for bytes, then in the order of merges."""

    CACHE = 1 << 20

    def __init__(self, merges: list[tuple[str, str]]):
        byte_of = _byte_of()
        number = {c: b for c, b in byte_of.items()}
        self.count = 256 + len(merges)
        self.left, self.right = np.arange(self.count), np.arange(self.count)
        strings = [bytes([b]) for b in range(256)]
        for place, (a, b) in enumerate(merges, 256):
            self.left[place], self.right[place] = number[a], number[b]
            number.setdefault(a + b, place)
            strings.append(bytes(byte_of[c] for c in a + b))
        self.length = np.array([len(s) for s in strings])
        key = self.left[256:] * self.count + self.right[256:]
        order = np.argsort(key)
        self.pair_key, self.pair_token = key[order], order + 256
        self._automaton(strings)
        self.cache_key = np.full(self.CACHE, -1, np.int64)
        self.cache_valid = np.zeros(self.CACHE, bool)
        # A token stands alone if merging its bytes ends in it, that is, if its two parts would be merged.
        self.alone = np.ones(self.count, bool)
        self.alone[256:] = self._merges_up(strings)

    def _automaton(self, strings: list[bytes]) -> None:
        child: list[dict[int, int]] = [{}]
        own = [-1]
        node_of = np.zeros(self.count, np.int64)
        for token, string in enumerate(strings):
            node = 0
            for b in string:
                after = child[node].get(b)
                if after is None:
                    after = child[node][b] = len(child)
                    child.append({})
                    own.append(-1)
                node = after
            if own[node] < 0:
                own[node] = token
            node_of[token] = node
        goto = np.zeros((len(child), 256), np.int32)
        fail = np.zeros(len(child), np.int64)
        longest = np.array(own)
        layer = [0]
        while layer:
            below = []
            for node in layer:
                if node:
                    goto[node] = goto[fail[node]]
                for b, after in child[node].items():
                    fail[after] = goto[fail[node], b] if node else 0
                    goto[node, b] = after
                    if longest[after] < 0:
                        longest[after] = longest[fail[after]]
                    below.append(after)
            layer = below
        self.goto, self.longest = goto, longest
        #: The next shorter token that ends where a token ends.
        self.shorter = longest[fail[node_of]]

    def _merges_up(self, strings: list[bytes]) -> np.ndarray:
        """For each merge: do its bytes end in this token? By the merge rules, longest tokens last."""
        ok = np.ones(self.count - 256, bool)
        merge = dict(zip(self.pair_key.tolist(), self.pair_token.tolist(), strict=True))
        for place in range(256, self.count):
            parts = list(strings[place])
            while len(parts) > 1:
                ranks = [merge.get(a * self.count + b, self.count) for a, b in zip(parts, parts[1:], strict=False)]
                best = min(ranks)
                if best == self.count:
                    break
                joined, at = [], 0
                while at < len(parts):
                    if at < len(ranks) and ranks[at] == best:
                        joined.append(best)
                        at += 2
                    else:
                        joined.append(parts[at])
                        at += 1
                parts = joined
            ok[place - 256] = parts == [place]
        return ok

    def _compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Would merging keep the border between these tokens?

        Undo merges on both sides of the border, latest first. The border falls
        if the two tokens that face each other at some time have a merge that comes earlier
        than the one that was undone last.
        """
        one, two = one.copy(), two.copy()
        valid = np.zeros(len(one), bool)
        limit = np.full(len(one), 2 * self.count, np.int64)
        live = np.arange(len(one))
        while len(live):
            a, b, top = one[live], two[live], limit[live]
            key = a * self.count + b
            spot = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            falls = (self.pair_key[spot] == key) & (self.pair_token[spot] < top)
            first = a > b
            # Undo the later token's merge; a byte has none, then the other token's turn comes.
            a_open, b_open = a >= 256, b >= 256
            cut_a = (first & a_open) | (~first & ~b_open & a_open)
            cut_b = (~first & b_open) | (first & ~a_open & b_open)
            done = ~falls & ~cut_a & ~cut_b
            valid[live[done]] = True
            limit[live] = np.where(cut_a, a, np.where(cut_b, b + 1, top))
            one[live] = np.where(cut_a, self.right[a], a)
            two[live] = np.where(cut_b, self.left[b], b)
            live = live[~falls & ~done]
        return valid

    def compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        key = one * self.count + two
        slot = (W.mix(key.view(np.uint64)) % W.U64(self.CACHE)).astype(np.int64)
        out = self.cache_valid[slot]
        miss = np.flatnonzero(self.cache_key[slot] != key)
        if len(miss):
            asked, back = np.unique(key[miss], return_inverse=True)
            answer = self._compatible(asked // self.count, asked % self.count)[back]
            out[miss] = answer
            self.cache_key[slot[miss]], self.cache_valid[slot[miss]] = key[miss], answer
        return out

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each data[start:end]."""
        size = end - start
        out = np.zeros(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        first = 0
        while first < len(order):
            # Strings of like length together; the table of last tokens stays small.
            longest = max(16, 2 * int(size[order[first]]))
            last = int(np.searchsorted(size[order], longest, side="right"))
            last = min(last, first + max(1, (1 << 22) // (longest + 1)))
            rows = order[first:last][::-1]
            out[rows] = self._lanes(data, start[rows], size[rows])
            first = last
        return out

    def _lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Longest strings first."""
        width = int(size[0]) if len(size) else 0
        last = np.full((len(size), width + 1), -1, np.int32)
        emitted = np.zeros((len(size), width + 1), np.int32)
        node = np.zeros(len(size), np.int64)
        for at in range(1, width + 1):
            lanes = int(np.searchsorted(-size, -at, side="right"))
            node = self.goto[node[:lanes], data[start[:lanes] + at - 1]].astype(np.int64)
            token = self.longest[node].copy()
            open_ = np.arange(lanes)
            while len(open_):
                t = token[open_]
                begin = at - self.length[t]
                before = last[open_, begin].astype(np.int64)
                ok = np.where(begin == 0, self.alone[t], False)
                inner = np.flatnonzero((begin > 0) & (before >= 0))
                if len(inner):
                    ok[inner] = self.alone[t[inner]] & self.compatible(before[inner], t[inner])
                token[open_] = np.where(ok, t, self.shorter[t])
                good = open_[ok]
                last[good, at] = token[good]
                emitted[good, at] = emitted[good, begin[ok]] + 1
                open_ = open_[~ok]
        return emitted[np.arange(len(size)), size]


# --- both together


class TokenCounter:
    """Token counts of texts as the vocabulary file's library gives them, without added tokens."""

    #: Distinct pre-tokens whose counts a worker keeps; beyond, it starts over.
    KEPT = 4_000_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.bpe = BpeCounter(merges)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in special)) if special else None
        self.symbols = symbol_table()
        self.known = HashRuns()

    def _segments(self, found: W.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Byte bounds of the texts cut around special strings, and which pieces are special."""
        raw = found.data.tobytes()
        cuts = []
        if self.special is not None:
            for number in {int(np.searchsorted(found.bounds, m.start(), side="right")) - 1 for m in self.special.finditer(raw)} | self._across(found, raw):
                a, b = found.bounds[number], found.bounds[number + 1]
                cuts += [(a + m.start(), a + m.end()) for m in self.special.finditer(raw[a:b])]
        if not cuts:
            return found.bounds, np.zeros(found.count, bool)
        cuts.sort()
        bounds = np.sort(np.concatenate([found.bounds, np.array(cuts).reshape(-1)]))
        bounds = np.unique(bounds) if len(bounds) else bounds
        return bounds, np.isin(bounds[:-1], [a for a, _ in cuts])

    def _across(self, found: W.Texts, raw: bytes) -> set[int]:
        """Texts that begin inside a match which joins two texts, whose own matches the search may have stepped over."""
        out = set()
        for m in self.special.finditer(raw):
            number = int(np.searchsorted(found.bounds, m.start(), side="right")) - 1
            while number < found.count and found.bounds[number] < m.end():
                out.add(number)
                number += 1
        return out

    def counts(self, found: W.Texts) -> np.ndarray:
        if not len(found.data):
            return np.zeros(found.count, np.int64)
        bounds, special = self._segments(found)
        points = np.frombuffer(found.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((found.data & 0xC0) != 0x80)
        edges = np.searchsorted(lead, bounds)
        symbols = self.symbols[points]
        for number in np.flatnonzero(special):
            symbols[edges[number] : edges[number + 1]] = RESET
        # A RESET behind every segment; character i of segment k stands at i + k.
        pieces = len(bounds) - 1
        place = np.arange(len(points)) + np.repeat(np.arange(pieces), np.diff(edges))
        stream = np.full(len(points) + pieces, RESET, np.uint8)
        stream[place] = symbols
        begin = np.flatnonzero(marks_of(stream)[place])
        start = lead[begin]
        stop = np.append(start[1:], len(found.data))
        # A pre-token ends where the next one begins, or with its segment.
        stop = np.minimum(stop, bounds[np.searchsorted(bounds, start, side="right")])
        hashes, sample, back = np.unique(W.run_hashes(found.data, start, stop), return_index=True, return_inverse=True)
        tokens = self.known.find(hashes)
        new = np.flatnonzero(tokens < 0)
        if len(new):
            if len(self.known) + len(new) > self.KEPT:
                self.known = HashRuns()
                new = np.arange(len(hashes))
            tokens[new] = self.bpe.counts(found.data, start[sample[new]], stop[sample[new]])
            self.known.add(hashes[new], tokens[new])
        total = np.concatenate([[0], np.cumsum(tokens[back])])
        out = np.diff(total[np.searchsorted(start, found.bounds)])
        if special.any():
            text = np.searchsorted(found.bounds, bounds[:-1][special], side="right") - 1
            np.add.at(out, text, 1)
        return out


_counters: dict[str, TokenCounter] = {}


def token_counter(path: str) -> TokenCounter:
    """The worker's compiled counter for a vocabulary file."""
    if path not in _counters:
        _counters[path] = TokenCounter(path)
    return _counters[path]
