"""Token counts by a compiled finite-state transducer.

The tokenizer (BPE with word ends, see ``public_tokenizers``) is compiled into a deterministic transducer that reads a text
character by character and emits token counts on its transitions:

* Words. A sequence of tokens is what BPE makes of its text where each two neighbours are (a merge over their border would be one
  of the two tokens alone), so the tokens of a prefix follow from those of shorter prefixes by its last token. A state (``State``) is the longest suffix of the word so
  far that begins a token, and for each place in it where a later token can begin, the last token before the place and the tokens up to it, less the least
  of those.
  Reading a byte moves to the next state and emits by how much that least number grew: tokens that no later byte can
  undo. A word's end emits the rest. There are finitely many states; they are made when first reached, and begun anew beyond
  STATES of them, so their table is a cache and never a limit.
* Splitter (``Splitter``). States over five character classes (letter, number, apostrophe, other, space) and the contractions; its
  transitions say where words end. Classes are asked from the tokenizer itself, once a character, as are the rules of
  normalisation: tables of another Unicode version would count otherwise.

From a word boundary, a whitespace-free fragment leads back to the boundary; the composition of its transitions is one macro
transition, kept in a bounded memo by fragment.

A text is cut into chunks of at most CHUNK code points, wherever the cut falls. A chunk's state map sends the automaton's state at
entry to its state at exit and the tokens emitted. Every space leads to the boundary, so a map is the characters before the first space
(to be read from the entry state), the tokens to the last space, and the state after the rest (``StateMap``); without a space it is the characters
alone. Maps compose associatively, and every text's count is the last of a parallel prefix scan (``scan``) over the maps of its chunks.

Defined results: null and empty texts have 0 bytes and 0 tokens; ``<|startoftext|>`` and
``<|endoftext|>`` inside a text count one token each, as the library does by default; repeated rows
give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Code points in a chunk, and states in the table.
CHUNK, STATES = 1 << 12, 100_000
#: Classes of the splitter's alphabet.
LETTER, NUMBER, APOSTROPHE, OTHER, SPACE = range(5)
#: What may follow an apostrophe in a contraction of the splitter.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Unicode White_Space, written for a character class.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WHITE = re.compile(f"[{WHITE}]+")
#: str.split() also splits here, where the tokenizer does not.
_PYTHON_ONLY = re.compile("[\\x1c-\\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(own))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Merges:
    """BPE merges by rank, leftmost first."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.rank = {p: i for i, p in enumerate(pairs)}

    def apply(self, symbols: list[str]) -> list[str]:
        """Short ones by looking for the least rank, others with a heap over a linked list (n log n)."""
        n, rank = len(symbols), self.rank
        if n <= 32:
            get, none = rank.get, 1 << 60
            ranks = [get(p, none) for p in zip(symbols, symbols[1:], strict=False)]
            while ranks and (best := min(ranks)) != none:
                at = ranks.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                del ranks[at]
                if at:
                    ranks[at - 1] = get((symbols[at - 1], symbols[at]), none)
                if at < len(ranks):
                    ranks[at] = get((symbols[at], symbols[at + 1]), none)
            return symbols
        left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 1, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := rank.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if not (alive[i] and j < n and alive[j] and right[i] == j and symbols[i] == a and symbols[j] == b):
                continue
            symbols[i], alive[j], right[i] = a + b, False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (r := rank.get((symbols[x], symbols[y]))) is not None:
                    heapq.heappush(heap, (r, x, y, symbols[x], symbols[y]))
        return [s for s, a in zip(symbols, alive, strict=False) if a]


class State:
    """A state of the word transducer, with its transitions so far: symbol -> (state, tokens emitted)."""

    __slots__ = ("next", "suffix", "window")

    def __init__(self, suffix: str, window: tuple[tuple[int, str, int], ...]):
        self.suffix, self.window, self.next = suffix, window, {}


class Words:
    """The word transducer: symbols are the stand-ins of bytes, one with END after it for a word's last byte."""

    END = "\n"  # no byte's stand-in

    def __init__(self, merges: list[tuple[str, str]], vocabulary: dict[str, int], end: str):
        mark = (lambda t: t[: -len(end)] + self.END if end and t.endswith(end) else t)
        pairs = [(mark(a), mark(b)) for a, b in merges]
        self.merges = Merges(pairs)
        self.tokens = {t: t for t in (*(a + b for a, b in pairs), *(t for t in map(mark, vocabulary) if len(t.rstrip(self.END)) == 1))}  # one string of each, for states and memos
        self.begins = {t[:i] for t in self.tokens for i in range(len(t)) if t[i] != self.END}
        self.follows, self.states = base.Memo(self._follows, 400_000, 1 << 30), {}
        self.reset()

    def symbols(self, t: str) -> list[str]:
        """A token's text by symbols; END belongs to the one before it."""
        return [*t[:-2], t[-2:]] if t.endswith(self.END) else list(t)

    def reset(self) -> None:
        for state in self.states.values():  # one that is in use would else keep all that it leads to
            state.next = {}
        self.start = State("", ((0, "", 0),))
        self.states = {("", self.start.window): self.start}
        self.follows.reset()

    def _follows(self, pair: tuple[str, str]) -> bool:
        """Does BPE make the second token, with the first before it ('' : with nothing before)?"""
        a, b = pair
        return self.merges.apply(self.symbols(a) + self.symbols(b)) == ([a, b] if a else [b])

    def step(self, state: State, symbol: str) -> tuple[State, int]:
        """The next state and the tokens emitted."""
        found = state.next.get(symbol)
        if found is None:
            found = state.next[symbol] = self._step(state, symbol)
        return found

    def _step(self, state: State, symbol: str) -> tuple[State, int]:
        text = state.suffix + symbol
        # the one token that ends here and follows what is before it
        for i, last, count in state.window:
            token = self.tokens.get(text[i:])
            if token is not None and self.follows[last, token]:
                break
        else:  # a byte's stand-in is always a token
            raise ValueError(f"no token ends at {text!r}")
        if symbol[-1] == self.END:
            return self.start, count + 1
        # the places where a later token can begin
        window = [(i, last, n) for i, last, n in state.window if text[i:] in self.begins]
        window.append((len(text), token, count + 1))
        keep, least = window[0][0], min(n for _, _, n in window)
        key = text[keep:], tuple((i - keep, last, n - least) for i, last, n in window)
        to = self.states.get(key)
        if to is None:
            if len(self.states) >= STATES:  # states in use live on alone, the table begins anew
                self.reset()
            to = self.states[key] = State(*key)
        return to, least


class Reading(NamedTuple):
    """A state of the whole automaton: the splitter's (one of FRESH, LETTERS, OTHERS, QUOTE), the letters that it holds back after an
    apostrophe, the word transducer's, and the last byte's stand-in, which may yet end the word."""

    mode: int
    held: str
    word: State
    last: str


FRESH, LETTERS, OTHERS, QUOTE = range(4)


class Transducer:
    """The compiled tokenizer. emitted[fragment]: the tokens of the macro transition from boundary to boundary."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        model = json.loads(spec)
        self.library = Tokenizer.from_str(spec)
        self.words = Words([tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]], model["model"]["vocab"], model["model"].get("end_of_word_suffix") or "")
        special = [t["content"] for t in model["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.bytes = byte_symbols()
        self.kind = base.Memo(self._kind, 1 << 21, 1 << 22)
        self.word = base.Memo(self._word)
        self.emitted = base.Memo(self._fragment)

    @property
    def boundary(self) -> Reading:
        """The state at a word's boundary, of the table in use: to hold one would keep every state since."""
        return Reading(FRESH, "", self.words.start, "")

    def _kind(self, c: str) -> int:
        """A character's class, by how the tokenizer splits it from a letter and from a mark."""
        if c == "'":
            return APOSTROPHE
        pieces = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
        return SPACE if not pieces(c) else LETTER if pieces("x" + c) == 1 else OTHER if pieces(c + "!") == 1 else NUMBER

    def normalise(self, s: str) -> str:
        """As the tokenizer does (runs of ASCII spaces stay: they end words whatever their length)."""
        return s.lower() if s.isascii() else self.library.normalizer.normalize_str(s)

    def read(self, at: Reading, s: str) -> tuple[Reading, int]:
        """The automaton reads characters: the state after them, and the tokens emitted."""
        mode, held, word, last = at
        step, symbols, start, end, total = self.words.step, self.bytes, self.words.start, Words.END, 0
        for c in s:
            kind = self.kind[c]
            # the splitter's transition: does a word end, which characters follow, does another end after them
            before = after = False
            take = c
            if mode == QUOTE and kind == LETTER and (x := held + c) in CONTRACTIONS:
                take, after, mode, held = x, True, FRESH, ""
            elif mode == QUOTE and kind == LETTER and any(y.startswith(x) for y in CONTRACTIONS):
                take, held = "", x
            elif kind == SPACE:
                before, take, after, mode, held = mode != FRESH, held, bool(held), FRESH, ""
            elif kind == LETTER:
                before, take, mode, held = mode != LETTERS, held + c, LETTERS, ""
            else:
                if held:  # its letters were no contraction: a word of their own after the apostrophe
                    (_, _, word, last), n = self.read(Reading(OTHERS, "", word, last), held)
                    total, mode, held = total + n, LETTERS, ""
                if kind == NUMBER:
                    before, after, mode = True, True, FRESH
                elif kind == APOSTROPHE and mode in (FRESH, LETTERS):
                    before, mode = True, QUOTE
                else:
                    before, mode = mode == LETTERS, OTHERS
            if before and last:
                word, n = step(word, last + end)
                total, last = total + n, ""
            for b in take.encode():
                if last:
                    word, n = step(word, last)
                    total += n
                last = symbols[b]
            if after:
                _, n = step(word, last + end)
                total, word, last = total + n, start, ""
        return Reading(mode, held, word, last), total

    def _word(self, w: str) -> int:
        """The word transducer over all of one word."""
        state, total, miss = self.words.start, 0, self.words.step
        symbols = [self.bytes[b] for b in w.encode()]
        last = symbols.pop()
        for x in symbols:
            state, n = state.next.get(x) or miss(state, x)
            total += n
        return total + miss(state, last + Words.END)[1]

    def _fragment(self, s: str) -> int:
        kinds = {self.kind[c] for c in s[:-1]}
        if len(kinds) < 2 and LETTER in kinds:  # letters, and letters with one mark: what the splitter does is plain
            if (k := self.kind[s[-1]]) == LETTER:
                return self.word[s]
            if k == OTHER:
                return self.word[s[:-1]] + self.word[s[-1]]
        return self.read(self.boundary, s + " ")[1]

    @staticmethod
    def fragments(s: str) -> list[str]:
        return [x for x in _WHITE.split(s) if x] if _PYTHON_ONLY.search(s) else s.split()

    def chunk_map(self, s: str) -> StateMap:
        """The state map of one chunk of normalised text."""
        inner = self.fragments(s)
        if not s or inner == [s]:
            return StateMap(s, None, None)
        head = "" if _WHITE.match(s) else inner.pop(0)
        tail = "" if _WHITE.match(s[-1]) else inner.pop()
        out, n = self.read(self.boundary, tail)
        return StateMap(head, n + sum(map(self.emitted.__getitem__, inner)), out)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First a, then b. Associative; StateMap('', None, None) is the identity."""
        if a.count is None:
            return StateMap(a.head + b.head, b.count, b.out)
        if b.count is None:
            out, n = self.read(a.out, b.head)
            return StateMap(a.head, a.count + n, out)
        return StateMap(a.head, a.count + self.read(a.out, b.head + " ")[1] + b.count, b.out)

    def total(self, m: StateMap) -> int:
        """Tokens from the boundary to the end of the text."""
        n = self.read(self.boundary, m.head + " ")[1]
        return n if m.count is None else n + m.count + self.read(m.out, " ")[1]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        total, parts = 0, [text]
        if self.special is not None and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            s = self.normalise(part)
            maps = [self.chunk_map(s[i : i + chunk]) for i in range(0, len(s), chunk)]
            if maps:
                total += self.total(scan(maps, self.compose)[-1])
        return total


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to the automaton. count None: no space in it, every state reads `head`. Else a state reads `head` and a
    space, then `count` tokens are emitted, and the state is `out`."""

    head: str
    count: int | None
    out: Reading | None


def scan(items: list, op: Callable) -> list:
    """Inclusive prefix scan: pairs are combined, their scan is taken, the gaps are filled; log n levels."""
    if len(items) < 2:
        return list(items)
    pairs = scan([op(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], op)
    out = [items[0]]
    for i in range(1, len(items)):
        out.append(pairs[i // 2] if i % 2 else op(pairs[i // 2 - 1], items[i]))
    return out


_COMPILED: dict[int, Transducer] = {}


def compiled(spec: str) -> Transducer:
    if (k := hash(spec)) not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[k] = Transducer(spec)
    return _COMPILED[k]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row. No shuffle.

    path: the tokenizer's file, read on the driver and sent with the task (1.7 MB, fixed)."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(spec)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = [t.count(x) for x in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) if x.isascii() else len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = base.map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
