"""Quality rules as a short-circuit cascade.

Every rule is a bound on one statistic of a text. Each task estimates the cost of each rule (seconds) and its selectivity
(share it rejects) on its first texts, so no text is read twice or sent to the driver; rules then run in the order of
rejection per cost, each only on the texts that the ones before it kept. Which texts are kept does not depend on that order,
so the sample changes speed alone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.llm import words as W

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_TRAIL = np.zeros(256, bool)
_TRAIL[0x80:0xC0] = True  # bytes after the first of a character


class Texts:
    """Texts of a slice with statistics that are computed at most once, and only for the rows asked for.

    What is computed for some rows is also entered for the whole slice, so that counts wanted of every text afterwards
    are computed for the others alone.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, whole: Texts | None = None, at: np.ndarray | None = None):
        self.data, self.offsets, self._kept = data, offsets, {}
        self.whole = self if whole is None else whole
        self.at = np.arange(len(offsets) - 1) if at is None else at
        self._entered: dict[str, tuple[np.ndarray, list[np.ndarray]]] = {}

    def rows(self, rows: np.ndarray) -> Texts:
        """The texts of some rows only."""
        if len(rows) == len(self.offsets) - 1:
            return self
        size = np.diff(self.offsets)[rows]
        offsets = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[:-1][rows] - offsets[:-1], size)
        out = Texts(self.data[at], offsets, self.whole, self.at[rows])
        for name, found in self._kept.items():  # what is known of these texts stays known
            if name == "words":
                first = np.concatenate(([0], np.cumsum(found.count[rows])))
                of = np.arange(first[-1]) + np.repeat(found.first[:-1][rows] - first[:-1], found.count[rows])
                moved = np.repeat(offsets[:-1] - self.offsets[:-1][rows], found.count[rows])
                out._kept[name] = W.Words(out.data, offsets, found.hash[of], found.start[of] + moved, found.end[of] + moved, first)
            else:
                out._kept[name] = [x[rows] for x in found]
        return out

    def of(self, name: str, compute: Callable[[], list[np.ndarray]]) -> list[np.ndarray]:
        """Arrays with a number a text."""
        if name not in self._kept:
            found = self._kept[name] = compute()
            n = len(self.whole.at)
            known, values = self.whole._entered.setdefault(name, (np.zeros(n, bool), [np.zeros(n, np.int64) for _ in found]))
            known[self.at] = True
            for x, y in zip(values, found, strict=True):
                x[self.at] = y
        return self._kept[name]

    def every(self, name: str) -> list[np.ndarray]:
        """A statistic of all texts of the slice: what a cascade has found, and of the texts left now."""
        entered = self.whole._entered.get(name)
        rest = self.whole.at if entered is None else np.flatnonzero(~entered[0])
        if len(rest) or entered is None:
            getattr(self.whole.rows(rest), name)()
        return self.whole._entered[name][1]

    def count_bytes(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask[self.data], dtype=np.int64)))
        return np.diff(total[self.offsets])

    @property
    def words(self) -> W.Words:
        if "words" not in self._kept:
            self._kept["words"] = W.tokenize(self.data, self.offsets)
        return self._kept["words"]

    def n_words(self) -> np.ndarray:
        return self.of("n_words", lambda: [self.words.count])[0]

    def word_chars(self) -> np.ndarray:
        """Code points inside words."""
        def compute() -> list[np.ndarray]:
            w = self.words
            size = np.concatenate(([0], np.cumsum(w.end - w.start)))
            return [np.diff(size[w.first]) - self.count_bytes(_TRAIL)]
        return self.of("word_chars", compute)[0]

    def n_symbols(self) -> np.ndarray:
        return self.of("n_symbols", lambda: [self.count_bytes(_SYMBOL)])[0]

    def n_upper_words(self) -> np.ndarray:
        """Words of two letters or more with no lower-case ASCII letter and none beyond ASCII."""
        def compute() -> list[np.ndarray]:
            w = self.words
            upper = np.concatenate(([0], np.cumsum(_UPPER[self.data], dtype=np.int64)))
            letter = np.concatenate(([0], np.cumsum(_LETTER[self.data], dtype=np.int64)))
            u, c = upper[w.end] - upper[w.start], letter[w.end] - letter[w.start]
            total = np.concatenate(([0], np.cumsum((u == c) & (u >= 2))))
            return [np.diff(total[w.first])]
        return self.of("n_upper_words", compute)[0]

    def lines(self) -> list[np.ndarray]:
        """Lines that hold a word, and those among them equal to an earlier line of the same text."""
        def compute() -> list[np.ndarray]:
            seen, again = np.zeros(len(self.offsets) - 1, np.int64), np.zeros(len(self.offsets) - 1, np.int64)
            raw = self.data.tobytes()
            for d, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)):
                found = [x for x in raw[a:b].split(b"\n") if x and not x.isspace()]
                seen[d], again[d] = len(found), len(found) - len(set(found))
            return [seen, again]
        return self.of("lines", compute)

    def n_repeat_words(self) -> np.ndarray:
        """Words inside an 8-word window that is found twice or more in the text."""
        def compute() -> list[np.ndarray]:
            w = self.words
            hashes, at = W.windows(w, 8)
            covered = np.zeros(len(w.hash) + 1, np.int64)
            if len(hashes):
                owner = w.text_of[at]
                with np.errstate(over="ignore"):
                    key = W.mix(hashes + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
                order = np.argsort(key)
                k, o, h = key[order], owner[order], hashes[order]
                same = (k[1:] == k[:-1]) & (o[1:] == o[:-1]) & (h[1:] == h[:-1])
                twice = np.zeros(len(k), bool)
                twice[1:] |= same
                twice[:-1] |= same
                begin = at[order[twice]]
                np.add.at(covered, begin, 1)
                np.add.at(covered, begin + 8, -1)
            total = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
            return [np.diff(total[w.first])]
        return self.of("n_repeat_words", compute)[0]


@dataclass(frozen=True)
class Rule:
    """A text is rejected where failed(texts) is true."""

    name: str
    failed: Callable[[Texts], np.ndarray]


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def rules(min_words: int = 20, max_repeat: float = 0.3, max_symbols: float = 0.1, max_dup_lines: float = 0.3, max_upper: float = 0.4, mean_word: tuple[float, float] = (2.0, 20.0)) -> list[Rule]:
    """The rules with their bounds: words at least, shares at most, mean length of a word in code points."""
    return [
        Rule("few_words", lambda t: t.n_words() < min_words),
        Rule("repeated_words", lambda t: t.n_repeat_words() > max_repeat * t.n_words() + 1e-9),
        Rule("symbols", lambda t: t.n_symbols() > max_symbols * t.n_words()),
        Rule("repeated_lines", lambda t: share(t.lines()[1], t.lines()[0]) > max_dup_lines),
        Rule("upper_case", lambda t: t.n_upper_words() > max_upper * t.n_words()),
        Rule("word_length", lambda t: (t.n_words() > 0) & ((share(t.word_chars(), t.n_words()) < mean_word[0]) | (share(t.word_chars(), t.n_words()) > mean_word[1]))),
    ]


class Cascade:
    """Rules of one task, in the order of rejection per cost over the texts judged so far, of which there are sample_rows or a
    few more; ties keep the given order."""

    def __init__(self, given: list[Rule], sample_rows: int, clock: Callable[[], float] = time.thread_time):
        self.given, self.ordered, self.sample_rows, self.clock = given, given, sample_rows, clock
        self.rejected, self.cost, self.seen = np.zeros(len(given)), np.zeros(len(given)), 0

    def measure(self, texts: Texts) -> None:
        """Try every rule on all texts; what it computes stays with them."""
        texts.n_words()  # the words, which most rules share, are no rule's own cost
        for k, rule in enumerate(self.given):
            began = self.clock()
            self.rejected[k] += int(rule.failed(texts).sum())
            self.cost[k] += self.clock() - began
        self.seen += len(texts.offsets) - 1
        gain = self.rejected / np.maximum(self.cost, 1e-6)
        self.ordered = [self.given[k] for k in sorted(range(len(self.given)), key=lambda k: (-gain[k], k))]

    def judge(self, texts: Texts) -> np.ndarray:
        """Per text the place in `ordered` of the rule that rejects it, as in cascade()."""
        if self.seen < self.sample_rows:
            self.measure(texts)
        return cascade(texts, self.ordered)


def cascade(texts: Texts, ordered: list[Rule]) -> np.ndarray:
    """The place in `ordered` of the rule that rejects each text; len(ordered) where none does."""
    n = len(texts.offsets) - 1
    verdict, alive = np.full(n, len(ordered)), np.arange(n)
    for k, rule in enumerate(ordered):
        if not len(alive):
            break
        bad = rule.failed(texts)
        verdict[alive[bad]] = k
        if bad.any():
            alive = alive[~bad]
            texts = texts.rows(np.flatnonzero(~bad))
    return verdict


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: list[Rule] | None = None, sample_rows: int = 200) -> DataFrame:
    """Per row: id, kept (no rule rejects the text) and rejected_by (the rule that stopped the cascade; of several that would
    reject a text, the one its task tries first).

    Every task orders the rules by its first sample_rows texts of any length. Null and empty texts have no words and fail
    the word count; rows are judged one by one, so repeated rows get equal verdicts, null ids stay null, extra columns are
    ignored and an empty table gives an empty result.
    """
    given = rules() if given is None else given
    kind = pa.schema([("id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Cascade(given, sample_rows)
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(1)):
                verdict = rows.judge(Texts(data, offsets))
                names = [rows.ordered[k].name if k < len(given) else None for k in verdict]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(verdict == len(given)), pa.array(names, pa.string())], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(W.releasing(run), "id long, kept boolean, rejected_by string").withColumnRenamed("id", id_col)


#: The counts that statistics() gives of every text.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", given: list[Rule] | None = None, min_words: int = 20, max_repeat_percent: int = 30, sample_rows: int = 200) -> DataFrame:
    """Per row the verdict of the cascade beside the full counts.

    base_failed: fewer than min_words words, or more than max_repeat_percent percent of the words lie in 8-word windows
    found twice or more. kept: not base_failed, and no rule of the cascade rejects the text. The cascade decides first;
    counts that it has found are taken from it, and those of texts that it rejected before are computed then. Counts are
    integers over the whole text. See quality_rules for the sample, nulls, empty texts, repeated rows and empty tables.
    """
    given = rules(min_words=min_words) if given is None else given
    kind = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Cascade(given, sample_rows)
        for batch in batches:
            for a, b, data, offsets in W.slices(batch.column(1)):
                t = Texts(data, offsets)
                verdict = rows.judge(t)
                names = [rows.ordered[k].name if k < len(given) else None for k in verdict]
                counts = [t.every("lines")[1] if c == "n_dup_lines" else t.every(c)[0] for c in COUNTS]
                n, repeated = counts[0], counts[4]
                failed = (n < min_words) | (100 * repeated > max_repeat_percent * n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in counts), pa.array(failed), pa.array(~failed & (verdict == len(given))), pa.array(names, pa.string())], schema=kind)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(W.releasing(run), f"id long, {', '.join(c + ' long' for c in COUNTS)}, base_failed boolean, kept boolean, rejected_by string").withColumnRenamed("id", id_col)
