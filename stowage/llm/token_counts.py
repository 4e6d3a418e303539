"""Exact token counts by a compiled finite-state tokenizer.

The merges of a byte-level BPE vocabulary are compiled, as texts need them,
into a deterministic transducer over bytes. Its state is what the past can
still change: for each recent cut of the current word, the last token of the
encoding up to there. Each transition carries the number of tokens it adds to
the encoding of the word so far (zero or less where tokens merge). The encoding
of a prefix ends in the one vocabulary token that fits behind the encoding of
the rest (two tokens fit if encoding their joined bytes gives the two back), so
a transition needs those last tokens alone.

A long text is cut into chunks. The state map of a chunk takes any state at its
start to one at its end: behind a word's end that white space follows, all
states agree. So a map is a head that still depends on the state before it, a
count, and a tail that is still open. Maps compose associatively, by a parallel
prefix scan over the chunks of all texts of a batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tables import documents

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK = 1 << 16  # characters
WORDS_KEPT = 400_000  # counts a worker remembers; beyond, it forgets all and starts again
STATES_KEPT = 400_000  # compiled states, likewise

# The word pattern of the vocabulary's pre-tokenizer. White space is spelt out,
# as the pattern library would count four control characters more.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
           rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if regex.match(f"[{SPACE}]", c))
CLOSED = rf"(?<=[^{SPACE}])(?=[{SPACE}])"  # behind a word that white space follows


def byte_letters() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What a task needs of a vocabulary file: merges in rank order, as bytes, and the special strings."""

    merges: tuple[tuple[bytes, bytes], ...]
    special: tuple[str, ...]

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        back = {letter: bytes([byte]) for byte, letter in enumerate(byte_letters())}

        def raw(token: str) -> bytes:
            return b"".join(back[c] for c in token)

        pairs = (m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"])
        return cls(tuple((raw(a), raw(b)) for a, b in pairs),
                   tuple(t["content"] for t in content["added_tokens"]))


class State:
    """What the past of a word can still change.

    ``recent`` holds its last bytes, as far back as a token could start.
    ``lasts`` and ``counts`` have an entry for each cut in them, latest first:
    the last token of the encoding up to the cut (None at the word's start, -1
    where no token can start) and
    the number of tokens there, less that at the latest cut.
    """

    __slots__ = ("recent", "lasts", "counts", "next")

    def __init__(self, recent: bytes, lasts: tuple, counts: tuple[int, ...]) -> None:
        self.recent, self.lasts, self.counts = recent, lasts, counts
        self.next: dict[int, tuple[State, int]] = {}


class Transducer:
    """States and transitions, compiled when first taken."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        # Tokens as numbers in the order of their merges; single bytes come first and are their own halves.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in vocabulary.merges:
            pair = self.number[a], self.number[b]
            self.joined[pair] = self.number[a + b] = len(self.halves)
            self.halves.append(pair)
        self.starts = {t[:i] for t in self.number for i in range(1, len(t) + 1)}
        self.whole = {n: self.alone(n) for n in self.number.values()}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.known_fits: dict[tuple[int, int], bool] = {}
        self.start = State(b"", (None,), (0,))

    def crowded(self) -> bool:
        return max(len(self.states), len(self.known_fits)) > STATES_KEPT

    def alone(self, token: int) -> bool:
        """Whether encoding the token's bytes gives the token."""
        left, right = self.halves[token]
        return token < 256 or self.joined[left, right] == token and self.fits_below(left, right, token)

    def fits_below(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge earlier than ``limit`` joins the end of ``left`` with the start of ``right``.

        The two are taken apart again, the later merge first; at each stage the
        pair that meets at the cut must not have been joined by an earlier merge
        than the one just taken apart.
        """
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right and left >= 256 or right < 256 <= left:
                limit, left = left, self.halves[left][1]
            elif right >= 256:
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def fits(self, left: int | None, right: int) -> bool:
        if left is None:
            return self.whole[right]
        known = self.known_fits.get((left, right))
        if known is None:
            known = self.known_fits[left, right] = self.fits_below(left, right, 1 << 60)
        return known

    def step(self, state: State, byte: int) -> tuple[State, int]:
        """Compile the transition on ``byte``: the next state and the tokens it adds."""
        recent = state.recent + bytes([byte])
        starts, number, length = self.starts, self.number, len(recent)
        known, depth, size, last = [], 0, 0, None
        for n in range(1, length + 1):
            suffix = recent[length - n:]
            # A cut that no token can start from any more is blotted out, so that equal futures meet.
            needed = suffix in starts
            known.append(needed)
            if needed:
                depth = n
                if not size:
                    token = number.get(suffix)
                    if token is not None and self.fits(state.lasts[n - 1], token):
                        size, last = n, token
        added = state.counts[size - 1] + 1
        del known[depth:]
        lasts = (last, *[x if k else -1 for x, k in zip(state.lasts, known)])
        counts = (0, *[c - added if k else 0 for c, k in zip(state.counts, known)])
        key = (recent[-depth:], lasts, counts)
        target = self.states.get(key)
        if target is None:
            target = self.states[key] = State(*key)
        state.next[byte] = found = (target, added)
        return found

    def count(self, word: str) -> int:
        """The sum of the transitions along a word."""
        state, total = self.start, 0
        for byte in word.encode():
            found = state.next.get(byte)
            if found is None:
                if self.crowded():
                    # Only this state goes on; those behind it can be compiled again.
                    state.next.clear()
                    self.clear()
                found = self.step(state, byte)
            state, added = found
            total += added
        return total


class Open(Exception):
    """A unit that does not end where white space begins."""


class Units(dict):
    """Token counts of a blank and what follows it up to the next; bounded like ``Counts``.

    A blank behind another letter than white space begins a new word, so such
    units are counted apart, and most of a text's are met before.
    """

    def __init__(self, words: Counts, find) -> None:
        super().__init__()
        self.words, self.find = words, find

    def __missing__(self, unit: str) -> int:
        if not unit or unit[-1] in _SPACES:
            raise Open
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = sum(map(self.words.__getitem__, self.find(" " + unit)))
        if len(unit) < 64:
            self[unit] = n
        return n


class Counts(dict):
    """Token counts of words met before; bounded, as words can be compiled again."""

    def __init__(self, transducer: Transducer) -> None:
        super().__init__()
        self.transducer = transducer

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        n = self.transducer.count(word)
        if len(word) < 64:
            self[word] = n
        return n


@dataclass(frozen=True)
class StateMap:
    """What a chunk does to any state before it. Without a closed word ``tail`` is None and all is head."""

    head: str
    count: int = 0
    tail: str | None = None


class Counter:
    """Counts tokens of texts by composing the state maps of their chunks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = Counts(Transducer(vocabulary))
        self.find = regex.compile(PATTERN).findall
        self.units = Units(self.words, self.find)
        self.closed = regex.compile(CLOSED)
        self.closed_last = regex.compile("(?r)" + CLOSED)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))
                                     or "(?!)")

    def section(self, text: str) -> int:
        """Tokens of a text that starts and ends where words do."""
        if self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(map(self.plain, parts))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        first, *units = text.split(" ")
        try:
            if not first or first[-1] in _SPACES:
                raise Open
            return sum(map(self.words.__getitem__, self.find(first))) + sum(map(self.units.__getitem__, units))
        except Open:
            return sum(map(self.words.__getitem__, self.find(text)))

    def state_map(self, chunk: str) -> StateMap:
        first = self.closed.search(chunk)
        if first is None:
            return StateMap(chunk)
        a, z = first.start(), self.closed_last.search(chunk).start()
        return StateMap(chunk[:a], self.section(chunk[a:z]), chunk[z:])

    def compose(self, x: StateMap, y: StateMap) -> StateMap:
        if x.tail is None:
            return StateMap(x.head + y.head, y.count, y.tail)
        if y.tail is None:
            return StateMap(x.head, x.count, x.tail + y.head)
        return StateMap(x.head, x.count + self.section(x.tail + y.head) + y.count, y.tail)

    def prefix_scan(self, maps: Sequence[StateMap], text_of: Sequence[int]) -> list[StateMap]:
        """Inclusive scan within each text, in a logarithmic number of rounds."""
        out, reach = list(maps), 1
        while any(text_of[i] == text_of[i - reach] for i in range(reach, len(out))):
            out = [self.compose(out[i - reach], m) if i >= reach and text_of[i - reach] == text_of[i] else m
                   for i, m in enumerate(out)]
            reach *= 2
        return out

    def totals(self, texts: Sequence[str], chunk: int = CHUNK) -> list[int]:
        pieces = [(i, t[a:a + chunk]) for i, t in enumerate(texts) for a in range(0, max(len(t), 1), chunk)]
        owner = [i for i, _ in pieces]
        maps = self.prefix_scan([self.state_map(p) for _, p in pieces], owner)
        last = {i: m for i, m in zip(owner, maps)}
        return [self.section(m.head) + m.count + self.section(m.tail or "") for _, m in sorted(last.items())]


_COUNTERS: dict[Vocabulary, Counter] = {}


def counter_of(vocabulary: Vocabulary) -> Counter:
    """The compiled tokenizer of this Python worker, kept from task to task."""
    if vocabulary not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[vocabulary] = Counter(vocabulary)
    return _COUNTERS[vocabulary]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``.

    The counts are those of the byte-level BPE file at ``path`` without tokens
    added at the ends; its special strings inside a text are one token each.
    A null text counts as empty: no bytes, no tokens. Texts of any length are
    counted whole. Rows that repeat and null ids are rows like others; other
    columns are ignored; an empty table gives an empty result. The vocabulary
    (a megabyte, whatever the corpus) goes to the tasks as a broadcast.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(
        Vocabulary.load(path or public_tokenizers.path(VOCABULARY)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary.value)
        for batch in batches:
            texts = batch.column("text")
            sizes = np.cumsum([0, *batch.column("n_bytes").to_pylist()])
            at = 0
            while at < batch.num_rows:  # about a megabyte at a time
                to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + (1 << 20), side="right")) - 1)
                part = [t or "" for t in texts.slice(at, to - at).to_pylist()]
                totals = counter.totals(part)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(at, to - at), batch.column("n_bytes").slice(at, to - at),
                     pa.array(totals, pa.int64()), pa.array([n > limit for n in totals])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
                at = to

    texts = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
