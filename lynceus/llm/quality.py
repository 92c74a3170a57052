"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lynceus.llm.words import SPACES, begin_task, covered, split_words, window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
REPEAT_WINDOW = 8
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


@dataclass(frozen=True)
class Facts:
    """What the base measures of one text leave for the rules."""

    words: list[bytes]
    raw: bytes
    lines: list[str]
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more in the text."""
    h = window_hashes(word_hashes(words), REPEAT_WINDOW)
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    return int(covered(np.flatnonzero(np.isin(h, twice)), REPEAT_WINDOW, len(words)).sum())


def measure(text: str | None) -> Facts:
    text = text or ""
    words = split_words(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return Facts(
        words,
        text.encode(),
        lines,
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def base_failed(f: Facts) -> bool:
    return f.n_words < 20 or 100 * f.n_repeat_words > 30 * f.n_words


def _symbols(f: Facts) -> bool:
    return 10 * f.n_symbols > f.n_words


def _word_length(f: Facts) -> bool:
    return f.word_chars < 2 * f.n_words or f.word_chars > 15 * f.n_words


def _dup_lines(f: Facts) -> bool:
    chars = sum(map(len, f.lines))
    return f.n_dup_lines > 0 and 10 * (chars - sum(map(len, set(f.lines)))) > 3 * chars


def _stutter(f: Facts) -> bool:
    return 10 * sum(a == b for a, b in zip(f.words, f.words[1:])) > 3 * f.n_words


def _count(raw: bytes, low: int, high: int) -> int:
    return len(raw) - len(raw.translate(None, bytes(range(low, high + 1))))


def _shouting(f: Facts) -> bool:
    capitals = _count(f.raw, 65, 90)
    return 10 * capitals > 6 * (capitals + _count(f.raw, 97, 122))


def _no_letters(f: Facts) -> bool:
    return 2 * sum(1 for w in f.words if not _LETTER.search(w)) > f.n_words


def _one_word(f: Facts) -> bool:
    return 10 * max(Counter(f.words).values(), default=0) > 4 * f.n_words


def _exclaimed(f: Facts) -> bool:
    return 10 * sum(w.endswith(b"!!") for w in f.words) > 3 * f.n_words


Rule = Callable[[Facts], bool]

#: name -> whether the rule rejects. Each looks at the whole text.
RULES: dict[str, Rule] = {
    "symbols": _symbols,
    "word_length": _word_length,
    "dup_lines": _dup_lines,
    "stutter": _stutter,
    "shouting": _shouting,
    "no_letters": _no_letters,
    "one_word": _one_word,
    "exclaimed": _exclaimed,
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_RESULT = pa.struct(
    [(c, pa.int64()) for c in MEASURES] + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())]
)
_RESULT_DDL = "struct<" + ",".join(f"{c}:bigint" for c in MEASURES) + ",base_failed:boolean,kept:boolean,rejected_by:string>"


def _tried(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each sampled text that the base rules keep: what every rule says and takes."""
    begin_task()
    for batch in batches:
        rejects, seconds = [], []
        for text in batch.column(0).to_pylist():
            facts = measure(text)
            if base_failed(facts):
                continue
            row, took = [], []
            for rule in RULES.values():
                began = time.perf_counter()
                row.append(rule(facts))
                took.append(time.perf_counter() - began)
            rejects.append(row)
            seconds.append(took)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rejects, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], ["rejects", "seconds"]
        )


def ordered_by_yield(rejects: np.ndarray, seconds: np.ndarray, names: Sequence[str]) -> list[str]:
    """Rules by rejections per second, each judged on the sample rows that the ones before it keep."""
    left, order = list(range(len(names))), []
    cost = seconds.mean(axis=0) + 1e-9 if len(seconds) else np.ones(len(names))
    alive = np.ones(len(rejects), bool)
    while left:
        rate = [rejects[alive, i].mean() / cost[i] if alive.any() else 0.0 for i in left]
        best = left[max(range(len(left)), key=lambda k: (rate[k], -cost[left[k]]))]
        order.append(names[best])
        alive &= ~rejects[:, best] if len(rejects) else alive
        left.remove(best)
    return order


def cascade_order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[str]:
    """The order of the rules, from a bounded random sample of the whole table.

    Only answers and times of at most about ``sample_rows`` rows reach the driver.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    rows = docs.count()
    sample = texts.sample(min(1.0, sample_rows / max(rows, 1)), seed) if rows > sample_rows else texts
    tried = sample.mapInArrow(_tried, "rejects array<boolean>, seconds array<double>").collect()
    names = list(RULES)
    return ordered_by_yield(
        np.array([r.rejects for r in tried], bool).reshape(-1, len(names)),
        np.array([r.seconds for r in tried], float).reshape(-1, len(names)),
        names,
    )


def verdict(text: str | None, order: Sequence[str]) -> dict:
    f = measure(text)
    failed = base_failed(f)
    by = "base" if failed else next((name for name in order if RULES[name](f)), None)
    return {c: getattr(f, c) for c in MEASURES} | {"base_failed": failed, "kept": by is None, "rejected_by": by}


def _judge(order: Sequence[str]) -> Callable[..., Column]:
    def judge(texts: pa.Array) -> pa.Array:
        begin_task()
        return pa.array([verdict(t, order) for t in texts.to_pylist()], _RESULT)

    return F.arrow_udf(judge, _RESULT_DDL).asNondeterministic()


def quality_rules(
    docs: DataFrame, text_col: str = "text", out_col: str = "quality", order: Sequence[str] | None = None
) -> DataFrame:
    """``docs`` with a struct: base measures, base_failed, kept and the rule that rejected.

    A text goes through the base rules and then the rest in the order of
    :func:`cascade_order`, and stops at the first that rejects it. The order
    changes the cost and ``rejected_by`` but never ``kept``, as a text is kept
    only if no rule rejects it. Null and empty texts have no words and fail the
    base rules. Rows, repeated ones too, are judged one by one; all columns stay,
    and one named like ``out_col`` is replaced. No shuffle.
    """
    order = list(order) if order is not None else cascade_order(docs, text_col)
    return docs.withColumn(out_col, _judge(order)(F.col(text_col).cast("string")))
