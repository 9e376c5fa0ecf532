"""Runs of words that repeat with a period, found by recursive frequency splitting.

Words are what white space (ASCII) separates.  A run is a stretch of consecutive words
whose smallest period q fits at least EXPONENT times and that holds at least SHORTEST
words, as long as it can be.  Every word of such a run occurs EXPONENT times in it at least.
So a word that occurs less often in its segment is in no run: it splits the segment.
The parts are counted again, until no word is too rare; segments too short for a run go.

The segments that are left are scanned by lags.  A run of period q agrees with itself,
shifted by q, on at least (EXPONENT - 1) * q words in a row, hence on a whole stretch of
two periods from some multiple of q on.  Only these stretches are compared, by prefix sums
of word hashes, so a segment of n words takes about n log n comparisons for all lags
together.  What agrees is verified word by word and extended to both sides.

Null, empty and blank texts have no words and no runs; their collapsed text is empty.  Rows
do not depend on each other, so repeated rows get equal results and an empty table none.
Texts of any length are read whole; a task holds about 4 MB of texts, or one that is longer.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import arrow_map, by_bytes, mixed, texts

EXPONENT, SHORTEST = 4, 6
PAIRS = 1 << 20  # comparisons made at once
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def numbered_words(words: list[bytes]) -> np.ndarray:
    """Each word as a number, equal for equal words."""
    known: defaultdict = defaultdict()
    known.default_factory = known.__len__
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def segments(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) in which every word occurs often enough, after splitting to stability.

    owner: which text a word belongs to; texts are first segments."""
    place, segment = np.arange(len(ids)), owner
    while len(place):
        span = int(ids.max()) + 1
        _, back, counts = np.unique(segment * span + ids, return_inverse=True, return_counts=True)
        common = counts[back] >= EXPONENT
        if common.all():
            break
        place, ids, segment = place[common], ids[common], segment[common]
        # A new segment begins where a word is missing or the old one ends.
        edge = np.ones(len(place), bool)
        edge[1:] = (np.diff(place) > 1) | (segment[1:] != segment[:-1])
        segment = np.cumsum(edge) - 1
        long = np.bincount(segment, minlength=1)[segment] >= SHORTEST
        place, ids, segment = place[long], ids[long], segment[long]
    if not len(place):
        return []
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    ends = np.r_[starts[1:], len(place)]
    return [(int(place[a]), int(place[b - 1]) + 1) for a, b in zip(starts, ends) if b - a >= SHORTEST]


class Scan:
    """The runs of one segment."""

    def __init__(self, ids: np.ndarray):
        self.ids, n = ids, len(ids)
        self.powers = np.cumprod(np.full(n + 1, SPREAD, np.uint64))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.sums[1:])
        #: The longest run found so far at each word: start, end and period.
        self.start, self.end, self.period = np.zeros((3, n), np.int64)
        self.found: dict[tuple[int, int], int] = {}

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs."""
        n, low = len(self.ids), 1
        while low <= n // EXPONENT:
            # Lags low to high - 1: about n / low stretches each.
            high = min(n // EXPONENT + 1, low + max(1, PAIRS * low // n))
            self.scan(low, high)
            low = high
        return sorted((start, length, q) for (start, length), q in self.found.items())

    def scan(self, low: int, high: int):
        n = len(self.ids)
        lags = np.arange(low, high)
        many = n // lags - 2  # stretches of two periods that have a third behind them
        lag = np.repeat(lags, many)
        multiple = np.arange(len(lag)) - np.repeat(np.cumsum(many) - many, many)
        at = multiple * lag
        s, shift = self.sums, self.powers[lag - 1]
        agree = (s[at + 2 * lag] - s[at]) * shift == s[at + 3 * lag] - s[at + lag]
        lag, multiple = lag[agree], multiple[agree]
        if not len(lag):
            return
        edge = np.flatnonzero(np.r_[True, (np.diff(lag) != 0) | (np.diff(multiple) != 1)])
        last = np.r_[edge[1:], len(lag)] - 1
        for q, a, b in zip(lag[edge].tolist(), multiple[edge].tolist(), multiple[last].tolist()):
            self.verify(q, a * q, (b + 2) * q)

    def verify(self, q: int, low: int, high: int):
        """Words low to high - 1 seem to equal those q further on: the run around them, if it is one."""
        middle = (low + high) // 2
        p = int(self.period[middle])
        if p and q % p == 0 and self.start[middle] <= low and self.end[middle] >= high + q:
            return  # a multiple of the period of a run that is known
        ids, n = self.ids, len(self.ids)
        # The neighbouring stretches did not agree, so fewer than q words are added on a side.
        a, b = max(0, low - q), min(n - q, high + q)
        same = np.r_[False, ids[a:b] == ids[a + q : b + q], False]
        edges = np.flatnonzero(same[1:] != same[:-1]) + a
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = stop - start + q
            if length >= max(SHORTEST, EXPONENT * q) and (start, length) not in self.found:
                self.found[start, length] = q
                inside = slice(start, start + length)
                if length > int((self.end[inside] - self.start[inside]).max()):
                    self.start[inside], self.end[inside], self.period[inside] = start, start + length, q


def runs_of(ids: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of all texts, by start and then period."""
    out = []
    for a, b in segments(ids, owner):
        out += [(a + start, length, q) for start, length, q in Scan(ids[a:b]).runs()]
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_runs(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df with two columns: row (all columns, as they came), and periodic, a struct
    of n_words, runs (start, length and period, in words, by start and then period) and collapsed,
    the words that stand in no run after its first period, joined by spaces."""
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text_col].cast("string").alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches):
        for batch in by_bytes(batches, 1):
            words = [t.split() for t in texts(batch.column(1))]
            sizes = np.array([len(w) for w in words], np.int64)
            ends = np.cumsum(sizes)
            ids = np.concatenate([np.empty(0, np.int64), *map(numbered_words, words)])
            found = runs_of(ids, np.repeat(np.arange(len(words)), sizes))
            starts = np.array([r[0] for r in found], np.int64)
            begin, stop = np.searchsorted(starts, ends - sizes), np.searchsorted(starts, ends)
            runs, collapsed = [], []
            for w, first, i, j in zip(words, (ends - sizes).tolist(), begin.tolist(), stop.tolist()):
                own = [(start - first, length, q) for start, length, q in found[i:j]]
                runs.append([dict(start=s, length=n, period=q) for s, n, q in own])
                collapsed.append(b" ".join(kept(w, own) if own else w))
            periodic = pa.StructArray.from_arrays([pa.array(sizes), pa.array(runs, pa.list_(run)), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([batch.column(0), periodic], names=["row", "periodic"])

    kind = rows.schema["row"].dataType.simpleString()
    return arrow_map(rows, work, f"row {kind}, periodic struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>")


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def repeated_tails(text, doc_id):
    """The text of a document as the query reads it: in a tenth of the documents, those whose
    h = crc32(id) ends in 0, the words from a = g % n on, g = h / 10, repeat the first
    p = 1 + (n - a) / (3 + g % 8) of them."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words).cast("bigint")
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    cycle = F.slice(words, a + 1, p)
    tail = F.flatten(F.array_repeat(cycle, F.ceil((n - a) / p).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n.cast("int")), " ")
    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), planted).otherwise(text)
