"""Spelling variants in a corpus: words one edit apart, by composing acceptors of the vocabulary."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.scale import cut_lineage, join_lookup

MIN_CHARS = 6
MIN_COUNT = 5
FORM_FACTOR = 5
# Words of one initial state that one task composes; beyond it the state is split at every position.
GROUP = 4096
HELD_WORDS = 300_000
OUT_ROWS = 50_000
ERASE_EVERY = 199

# Letters as Latin-1 bytes, capitals of A-Z already lower-cased.
_RUN = re.compile(rb"[a-z\xc0-\xff]+")
PAIR = "a string, n_a bigint, b string, n_b bigint"


def document_words(doc_id: int | None, text: str, min_chars: int = MIN_CHARS) -> Counter:
    """Words of a text as Latin-1 bytes, with their occurrences.

    A run whose hash with the id is divisible by 199 loses one letter: planted misspellings, which the
    variant search is held against. A null id plants none.
    """
    out: Counter = Counter()
    start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    # bytes.lower() folds A-Z only; what Latin-1 lacks becomes "?", no letter
    for run, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
        if len(run) < min_chars:
            continue
        if start is not None:
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
            if h % ERASE_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
                if len(run) < min_chars:
                    continue
        out[run] += n
    return out


def _counted(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if text.is_valid:
                    held.update(document_words(doc_id.as_py(), text.as_py(), min_chars))
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return run


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n) of all words of at least ``min_chars`` letters and ``min_count`` occurrences.

    A task counts its texts before the shuffle, so a frequent word travels once per task. Null and
    empty texts have no words. Rows that repeat an id or a text count each. Other columns are not read.
    """
    words = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    counts = words.mapInArrow(_counted(min_chars), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic automaton of a sorted list of distinct words.

    ``arcs[q]`` leads from state q by symbol, ``final`` holds the accepting states, and
    ``shortest[q]`` to ``longest[q]`` are the lengths that q still accepts. Words of a group differ
    by one in length at most, so every length between is accepted too.
    """

    def __init__(self, words: Iterable[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.shortest: list[int] = []
        self.longest: list[int] = []
        known: dict[tuple, int] = {}
        # states of the last word that may still get arcs: [final, arcs]
        path: list[list] = [[False, {}]]
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth:
                final, arcs = path.pop()
                key = (final, *arcs.items())
                state = known.get(key)
                if state is None:
                    state = known[key] = len(self.arcs)
                    self.arcs.append(arcs)
                    self.final.append(final)
                    self.shortest.append(0 if final else 1 + min(self.shortest[q] for q in arcs.values()))
                    self.longest.append(max((1 + self.longest[q] for q in arcs.values()), default=0))
                if path:
                    path[-1][1][last[len(path) - 1]] = state
                self.start = state

        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            close(same + 1)
            last = word
            path += [[False, {}] for _ in word[same:]]
            path[-1][0] = True
        close(0)

    def accepts(self, q: int, n: int) -> bool:
        return self.shortest[q] <= n <= self.longest[q]

    def common(self, p: int, q: int, n: int, not_first: str = "") -> Iterator[str]:
        """Strings of length ``n`` that both states accept."""
        stack = [(p, q, "")]
        while stack:
            p, q, at = stack.pop()
            left = n - len(at)
            if not left:
                if self.final[p] and self.final[q]:
                    yield at
                continue
            others = self.arcs[q]
            for symbol, to in self.arcs[p].items():
                beside = others.get(symbol)
                if beside is None or (not at and symbol == not_first):
                    continue
                if self.accepts(to, left - 1) and self.accepts(beside, left - 1):
                    stack.append((to, beside, at + symbol))

    def one_edit_pairs(self, n: int) -> Iterator[tuple[str, str]]:
        """Accepted words one edit apart, the first of length ``n``, the other ``n`` or ``n + 1``; each pair once.

        The composition of the acceptor, the one-edit transducer and the acceptor. Its states are a
        state, the edits spent and a state. Before the edit both sides read the same symbols and are in one state; the edit
        leads to two states, and what both accept from there ends the words.
        """
        stack = [(self.start, "")]
        while stack:
            q, read = stack.pop()
            left = n - len(read)
            arcs = list(self.arcs[q].items())
            if self.accepts(q, left):
                for symbol, to in arcs:
                    # an inserted symbol counts as the last of its run, so the rest begins otherwise
                    if self.accepts(to, left):
                        for rest in self.common(q, to, left, symbol):
                            yield read + rest, read + symbol + rest
            if left > 0:
                able = [(symbol, to) for symbol, to in arcs if self.accepts(to, left - 1)]
                for i, (a, p) in enumerate(able):
                    for b, r in able[i + 1 :]:
                        for rest in self.common(p, r, left - 1):
                            yield read + a + rest, read + b + rest
            if self.longest[q] > 1:
                stack += [(to, read + symbol) for symbol, to in arcs]


def _same_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _batches(pairs: Iterable[tuple[str, int, str, int]]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    held: list[tuple] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["a", "n_a", "b", "n_b"])

    for pair in pairs:
        held.append(pair)
        if len(held) >= OUT_ROWS:
            yield out()
            held = []
    if held:
        yield out()


def _grouped(batches: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of one task at a time, from batches sorted by task; groups of one row have no pairs."""
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in ["task", *columns]]))
    for _, group in itertools.groupby(rows, key=lambda row: row[0]):
        found = [row[1:] for row in group]
        if len(found) > 1:
            yield found


def _composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of every initial state: words of ``size`` and ``size + 1`` letters that begin (or end) alike."""

    def pairs() -> Iterator[tuple[str, int, str, int]]:
        for group in _grouped(batches, ["size", "back", "word", "n"]):
            size, back = group[0][:2]
            counts = {word: n for _, _, word, n in group}
            head = size // 2
            cut = size - head if back else head
            turned = {(w[::-1] if back else w)[cut:]: w for w in counts}
            for a, b in Acceptor(sorted(turned)).one_edit_pairs(size - cut):
                a, b = turned[a], turned[b]
                # words that also begin alike are found there
                if not back or _same_start(a, b) < head:
                    yield a, counts[a], b, counts[b]

    yield from _batches(pairs())


def _holes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of words that are alike but for one position."""

    def pairs() -> Iterator[tuple[str, int, str, int]]:
        for group in _grouped(batches, ["size", "back", "at", "rest", "word", "n"]):
            rows = sorted(set(group))
            for i, (size, back, at, rest, a, n_a) in enumerate(rows):
                for s, k, p, r, b, n_b in rows[i + 1 :]:
                    if (s, k, p, r) != (size, back, at, rest):
                        break
                    # an insertion pairs the short word with longer ones, a replacement words of one length
                    if (at < 0) == (len(a) != len(b)) and (not back or _same_start(a, b) < size // 2):
                        yield (a, n_a, b, n_b)

    yield from _batches(pairs())


def _opened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every word of a crowded state without one symbol, at each position that its half leaves open."""
    names = ["size", "back", "at", "rest", "word", "n"]
    kinds = (pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        held: list[tuple] = []
        chars = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

        for row in batch.select(["size", "back", "word", "n"]).to_pylist():
            size, back, word, n = row["size"], row["back"], row["word"], row["n"]
            seen = word[::-1] if back else word
            cut = size - size // 2 if back else size // 2
            if len(word) == size:
                held.append((size, back, -1, seen, word, n))
            for i in range(cut, len(word)):
                rest = seen[:i] + seen[i + 1 :]
                if len(word) == size:
                    held.append((size, back, i, rest, word, n))
                elif i + 1 == len(word) or seen[i + 1] != seen[i]:
                    held.append((size, back, -1, rest, word, n))
                chars += len(rest)
                if len(held) >= OUT_ROWS or chars > 8_000_000:
                    yield out()
                    held, chars = [], 0
        if held:
            yield out()


def near_pairs(words: DataFrame, min_chars: int = MIN_CHARS, group: int = GROUP) -> DataFrame:
    """(a, n_a, b, n_b): words that differ by exactly one inserted, deleted or replaced code point, each pair once.

    Of a pair, let the shorter word have s letters. The edit lies behind the first s // 2 letters or before the last s - s // 2, so
    the words share one of these halves. Words of s and s + 1 letters that share a half stand in one partition. The half
    leads the acceptor of the vocabulary (of the vocabulary read backwards, for last halves) to a state; the partition holds
    what is accepted from it, minimised, and enumerates the composition from there.

    States of more than ``group`` words are not composed in one task: their words are spread by what is left
    without one symbol, for every symbol behind the half, which gives the same pairs. ``words`` has distinct
    words of at least ``min_chars`` letters and their n; an empty table gives no pair. Words of
    any length are whole.
    """
    length = F.length("word")
    places = []
    for less in (0, 1):
        size = length - less
        for back in (False, True):
            part = F.right(F.col("word"), size - F.floor(size / 2).cast("int")) if back else F.left(F.col("word"), F.floor(size / 2).cast("int"))
            place = F.struct(size.alias("size"), F.lit(back).alias("back"), F.concat_ws(":", size.cast("string"), F.lit(str(back)), part).alias("task"))
            places.append(F.when(size >= min_chars, place))
    rows = words.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("place")).select("word", "n", "place.*")
    crowds = rows.groupBy(F.col("task").alias("crowd")).agg(F.count("*").alias("members")).where(F.col("members") > group)
    crowds = cut_lineage(crowds.select("crowd"), "spelling-crowds")
    crowded = not crowds.isEmpty()
    lone = rows.join(crowds, F.col("task") == F.col("crowd"), "left_anti") if crowded else rows
    pairs = lone.repartition("task").sortWithinPartitions("task").mapInArrow(_composed, PAIR)
    if crowded:
        split = rows.join(crowds, F.col("task") == F.col("crowd"), "left_semi").select("size", "back", "word", "n")
        opened = split.mapInArrow(_opened, "size int, back boolean, at int, rest string, word string, n bigint")
        opened = opened.withColumn("task", F.xxhash64("size", "back", "at", "rest"))
        pairs = pairs.unionAll(opened.repartition("task").sortWithinPartitions("task").mapInArrow(_holes, PAIR))
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the last of its forms. A form's n is larger, so chains end.

    Each round doubles the forms that are followed.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        now = cut_lineage(now, "spelling-roots")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = join_lookup(now, ahead, ["root"], "left")
        if moved.where("next IS NOT NULL").isEmpty():
            return now
        now = moved.select("word", F.coalesce("next", "root").alias("root"))


def variant_groups(words: DataFrame, factor: int = FORM_FACTOR, min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that n is at least
    ``factor`` times its own. An empty table gives an empty result.
    """
    words = cut_lineage(words.select("word", "n"), "spelling-words")
    pairs = cut_lineage(near_pairs(words, min_chars), "spelling-pairs")
    ends = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"n_{a}").alias("n"), F.col(b).alias("near"), F.col(f"n_{b}").alias("m"))
    near = pairs.select(F.explode(F.array(ends("a", "b"), ends("b", "a"))).alias("x")).select("x.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("own"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    large: Column = -F.col("best.less") >= factor * F.col("own")
    best = best.select(
        F.col("word").alias("of"), "n_near", F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")
    )
    best = cut_lineage(best, "spelling-forms")
    last = roots(best.where("form IS NOT NULL").select(F.col("of").alias("word"), "form"))
    out = words.join(best, F.col("word") == F.col("of"), "left")
    out = out.join(last.select(F.col("word").alias("from"), "root"), F.col("word") == F.col("from"), "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"
    )
