"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers replace the tokenizer's merge loop.

* The splitter reads character classes and marks where pieces start. A text batch is one long string cut into
  chunks; every chunk's map from entry state to exit state is computed for all chunks at once, the maps are composed
  by a parallel prefix scan, and a second pass, from the now known entry states, reads off the piece starts. One very
  long text is therefore processed in parallel like many short ones.
* The piece transducer reads bytes. Its state holds, for every place where a vocabulary entry may still be running, the
  entry's trie node, the token that ends where it began and the token count there; a transition carries the change of
  the token count. That is enough because in byte-pair encoding a sequence is the encoding of its bytes exactly if all
  neighbouring tokens are, so that the last token of every prefix follows from earlier last tokens. States are
  compiled when they are first met and kept per Python worker, up to a bound; past it, only states in use stay. A long
  piece is cut into chunks as well: a chunk's map takes an entry state to an exit state and the tokens emitted on the
  way. Maps start from likely entry states, which some bytes ahead of the chunk suggest, grow by the exits of the chunk
  before until they hold the text's own way, and are composed pairwise.

Counts equal those of the tokenizers library for a byte-level BPE file with the usual splitting rule.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import shown_bytes
from .common import map_texts

#: Character classes of the splitter. The letters are those of the contractions 's 't 'm 'd 're 've 'll.
LETTER, NUMBER, OTHER, SPACE, WHITE, APOSTROPHE, STMD, CH_R, CH_V, CH_E, CH_L, SEP = range(12)
N_CLASSES = 12
#: States: at a text's start, in letters, numbers, others, white space ending in a space or in another, after an
#: apostrophe that starts a piece, after 'r, 'v, 'l, and after a whole contraction.
START, IN_L, IN_N, IN_O, IN_S, IN_W, APOS, APOS_R, APOS_V, APOS_L, DONE = range(11)
N_STATES = 11
#: Emissions: a piece starts at this character; one starts at the character before.
HERE, BEFORE = 1, 2
#: The piece transducer's state before the first byte.
START_STATE = ((0, -1, 0),)
#: Bytes of a chunk of a long piece, bytes ahead of it that suggest its entry state, and entry states that are tried
#: besides the one that is needed.
CHUNK, AHEAD, MOST_ENTRIES = 2048, 64, 8


def splitter_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by state * N_CLASSES + class."""
    step = np.zeros((N_STATES, N_CLASSES), np.uint8)
    emit = np.zeros((N_STATES, N_CLASSES), np.uint8)
    letters = (LETTER, STMD, CH_R, CH_V, CH_E, CH_L)
    kind = dict.fromkeys(letters, IN_L) | {NUMBER: IN_N, OTHER: IN_O, SPACE: IN_S, WHITE: IN_W, APOSTROPHE: APOS}
    for state in range(N_STATES):
        for c in range(N_CLASSES):
            to, out = (START, 0) if c == SEP else (kind[c], HERE)
            if state == IN_L and c in letters or state == IN_N and c == NUMBER or state == IN_O and c in (OTHER, APOSTROPHE):
                to, out = state, 0
            elif state in (IN_S, IN_W) and c in (SPACE, WHITE):
                out = 0
            elif state == IN_S and c != SEP:  # the space goes with what follows it
                to, out = (IN_O if c == APOSTROPHE else to), BEFORE
            elif state == IN_W and c != SEP:  # the last white space stands alone
                out = HERE | BEFORE
            elif state == APOS and c in (STMD, CH_R, CH_V, CH_L):
                to, out = {STMD: DONE, CH_R: APOS_R, CH_V: APOS_V, CH_L: APOS_L}[c], 0
            elif state == APOS and c in (OTHER, APOSTROPHE):
                to, out = IN_O, 0
            elif state in (APOS_R, APOS_V) and c == CH_E or state == APOS_L and c == CH_L:
                to, out = DONE, 0
            elif state in (APOS_R, APOS_V, APOS_L):  # the apostrophe stood alone, its letter starts a word
                to, out = (IN_L, BEFORE) if c in letters else (to, out | BEFORE)
            step[state, c], emit[state, c] = to, out
    return step.ravel(), emit.ravel()


def character_classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for pattern, c in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a : b + 1] = c
    table[0xD800:0xE000] = OTHER
    for ch, c in ((" ", SPACE), ("'", APOSTROPHE), ("r", CH_R), ("v", CH_V), ("e", CH_E), ("l", CH_L), *((x, STMD) for x in "stmd")):
        table[ord(ch)] = c
    return table


def piece_starts(classes: np.ndarray, step: np.ndarray, emit: np.ndarray, chunk: int = 128) -> np.ndarray:
    """True where a piece starts. Chunk state maps are composed by a prefix scan over all chunks."""
    n = len(classes)
    k = -(-n // chunk)
    grid = np.full(k * chunk, SEP, np.uint8)
    grid[:n] = classes
    cols = np.ascontiguousarray(grid.reshape(k, chunk).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], k, 1)
    for c in cols:
        maps = step.take(maps * np.uint8(N_CLASSES) + c)
    maps = np.ascontiguousarray(maps.T)
    d = 1
    while d < k:
        maps[d:] = np.take_along_axis(maps[d:], maps[:-d].astype(np.intp), 1)
        d *= 2
    state = np.empty(k, np.uint8)
    state[0] = START
    state[1:] = maps[:-1, START]
    out = np.empty((chunk, k), np.uint8)
    for j, c in enumerate(cols):
        at = state * np.uint8(N_CLASSES) + c
        out[j] = emit.take(at)
        state = step.take(at)
    marks = out.T.ravel()[:n]
    starts = (marks & HERE).astype(bool)
    starts[:-1] |= (marks[1:] & BEFORE).astype(bool)
    return starts


class Splitter:
    """Cuts a batch of texts into pieces; `cut` tells the pieces' places in the joined batch and their texts."""

    def __init__(self) -> None:
        self.step, self.emit = splitter_tables()
        self.classes = character_classes()

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The batch as one string, its code points, and each piece's start, end (code points) and text number."""
        joined = "\n".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes.take(points)
        seps = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        classes[seps] = SEP
        starts = piece_starts(classes, self.step, self.emit)
        is_sep = np.zeros(len(points), bool)
        is_sep[seps] = True
        starts &= ~is_sep
        edges = np.flatnonzero(starts | is_sep)
        first = starts[edges]
        begin, end = edges[:-1][first[:-1]], edges[1:][first[:-1]]
        return joined, points, begin, end, np.searchsorted(seps, begin)


class PieceTransducer:
    """Byte transducer whose transitions carry emitted-token counts; compiled lazily from ranks and merges."""

    def __init__(self, tokens: dict[bytes, int], merges: dict[tuple[int, int], tuple[int, int]]):
        self.merges = merges
        self.bytes_of = {i: t for t, i in tokens.items()}
        self.single = {t[0]: i for t, i in tokens.items() if len(t) == 1}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for t, i in tokens.items():
            node = 0
            for b in t:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.next = np.full((1024, 256), -1, np.int32)
        self.add = np.zeros((1024, 256), np.int8)
        self.number(START_STATE)

    def number(self, key: tuple) -> int:
        """The number of a state, a new one if it has none."""
        at = self.ids.get(key)
        if at is None:
            at = self.ids[key] = len(self.states)
            self.states.append(key)
            if at >= len(self.next):
                more = min(len(self.next), 16_384)
                self.next = np.concatenate([self.next, np.full((more, 256), -1, np.int32)])
                self.add = np.concatenate([self.add, np.zeros((more, 256), np.int8)])
        return at

    def renew(self, state: np.ndarray) -> np.ndarray:
        """Forget all states but those in use; their new numbers."""
        used, at = np.unique(state, return_inverse=True)
        keys = [self.states[x] for x in used.tolist()]
        self.reset()
        return np.array([self.number(k) for k in keys], np.int64)[at]

    def encode(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                m = self.merges.get((ids[i], ids[i + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return ids

    def compatible(self, left: int, right: int) -> bool:
        got = self.fits.get((left, right))
        if got is None:
            got = self.fits[left, right] = self.encode(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return got

    def compile(self, state: int, byte: int) -> None:
        grown, last = [], None
        for node, before, count in self.states[state]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            t = self.token[to]
            if last is None and t >= 0 and (before < 0 or self.compatible(before, t)):
                last = (t, count + 1)
            if self.child[to]:
                grown.append((to, before, count))
        token, delta = last
        key = (*((n, b, c - delta) for n, b, c in grown), (0, token, 0))
        to = self.number(key)
        self.next[state, byte], self.add[state, byte] = to, delta

    def run(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray, most_states: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens emitted over each data[start:start+length] from its entry state, and the exit states; all advance
        together, one byte a step."""
        order = np.argsort(-length, kind="stable")
        at, left = start[order], length[order]
        total, state = np.zeros(len(order), np.int64), entry[order].astype(np.int64)
        alive = np.searchsorted(-left, -np.arange(1, int(left[0]) + 1 if len(left) else 1), "right")
        for k, n in enumerate(alive):
            if len(self.states) > most_states:  # bounded memory: compiled again as met
                state = self.renew(state)
            key = state[:n] * 256 + data[at[:n] + k]
            to = self.next.ravel().take(key)
            if (missing := to < 0).any():
                for x in np.unique(key[missing]).tolist():
                    self.compile(x >> 8, x & 255)
                to = self.next.ravel().take(key)
            total[:n] += self.add.ravel().take(key)
            state[:n] = to
        tokens, end = np.empty_like(total), np.empty_like(state)
        tokens[order], end[order] = total, state
        return tokens, end

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, most_states: int = 160_000) -> np.ndarray:
        """Tokens of each piece data[start:start+length]."""
        long = length > 2 * CHUNK
        out = np.zeros(len(start), np.int64)
        if len(self.states) > most_states:
            self.reset()
        out[~long], _ = self.run(data, start[~long], length[~long], np.zeros(int((~long).sum()), np.int64), most_states)
        for i in np.flatnonzero(long).tolist():
            out[i] = self.count_long(data, int(start[i]), int(length[i]), most_states)
        return out

    def count_long(self, data: np.ndarray, start: int, length: int, most_states: int) -> int:
        """Tokens of one long piece, by chunk maps {entry state: (exit state, tokens)}."""
        cuts = start + np.arange(0, length, CHUNK)
        sizes = np.minimum(CHUNK, start + length - cuts)
        maps: list[dict[tuple, tuple[tuple, int]]] = [{} for _ in cuts]

        def walked(chunks: list[int], entries: list[tuple], ahead: int = 0) -> list[tuple[tuple, int]]:
            if len(self.states) > most_states:
                self.reset()
            at = np.array(chunks)
            begin, size = (cuts[at] - ahead, np.full(len(at), ahead)) if ahead else (cuts[at], sizes[at])
            tokens, end = self.run(data, begin, size, np.array([self.number(k) for k in entries]), most_states)
            return [(self.states[e], n) for e, n in zip(end.tolist(), tokens.tolist(), strict=True)]

        rest = list(range(1, len(cuts)))
        likely = walked(rest, [START_STATE] * len(rest), AHEAD)
        wanted = {(0, START_STATE)} | {(i, state) for i, (state, _) in zip(rest, likely, strict=True)}
        while True:
            todo = sorted(wanted, key=lambda x: x[0])
            for (i, entry), got in zip(todo, walked([i for i, _ in todo], [s for _, s in todo]), strict=True):
                maps[i][entry] = got
            state, i = START_STATE, 0  # the text's own way, as far as the maps know it
            while i < len(maps) and state in maps[i]:
                state, i = maps[i][state][0], i + 1
            if i == len(maps):
                break
            wanted = {(i, state)} | {(j + 1, x) for j, f in enumerate(maps[:-1]) for x, _ in f.values() if x not in maps[j + 1] and len(maps[j + 1]) < MOST_ENTRIES}
        while len(maps) > 1:
            maps = [composed(*maps[j : j + 2]) for j in range(0, len(maps), 2)]
        return maps[0][START_STATE][1]


def composed(first: dict, then: dict | None = None) -> dict:
    """The map of two neighbouring chunks: exits of the first enter the second, token counts add up."""
    if then is None:
        return first
    return {s: (then[x][0], n + then[x][1]) for s, (x, n) in first.items() if x in then}


class CompiledTokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(shown_bytes())}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        raw = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        merges = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.special = sorted(special, key=len, reverse=True)
        self.pieces = PieceTransducer(raw, merges)
        self.splitter = Splitter()

    def count(self, texts: list[str]) -> list[int]:
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            cut = [t]
            for s in self.special:
                if s in t:
                    found = [x.split(s) for x in cut]
                    extra[i] += sum(len(x) - 1 for x in found)
                    cut = [y for x in found for y in x]
            parts += cut
            owner += [i] * len(cut)
        joined, points, begin, end, part = self.splitter.cut(parts)
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        offset = np.zeros(len(points) + 1, np.int64)
        np.cumsum(width, out=offset[1:])
        data = np.frombuffer(joined.encode(), np.uint8)
        tokens = self.pieces.counts(data, offset[begin], offset[end] - offset[begin])
        which = np.asarray(owner, np.int64)[part]
        return (np.bincount(which, tokens, len(texts)).astype(np.int64) + extra).tolist()


_compiled: dict[str, CompiledTokenizer] = {}


def compiled(path: str) -> CompiledTokenizer:
    if path not in _compiled:
        _compiled[path] = CompiledTokenizer(path)
    return _compiled[path]


def token_counts(df: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of `df`: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Texts are read whole, however long; equal rows give equal rows; an
    empty table gives an empty result; other columns, whatever their names, are ignored. Special strings inside a text
    count as one token each, as the library has it by default. `tokenizer` is a path that every executor can read.
    """

    def work(texts: list[str]) -> list[list]:
        n = compiled(tokenizer).count(texts)
        return [[len(t.encode()) for t in texts], n, [x > limit for x in n]]

    return map_texts(df, [key], text, "n_bytes long, n_tokens long, over_limit boolean", work)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from public_tokenizers import path

    from .common import table

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", F.col("text")), path("byte_bpe_50k.json"))
