"""Benchmark decontamination with a generalised suffix automaton of the test items.

Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII.
A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is
one window.  The words of a document run through the automaton, which tracks at each
word the longest run ending there that occurs in some item.  A run of WINDOW words or
more is a hit over its whole length, and so is an occurrence of a whole short item.

Words that no item has, and neighbours that are neighbours in no item, end every run;
stretches without a run long enough are not walked at all.

The items are taken in shards of at most SHARD_WORDS words (a longer item is a shard of
its own), so an automaton has a bounded size; each shard is one pass over the documents.

Null and empty texts have no words and no hits.  Items without id, text or words are no
items.  Rows that agree in doc_id and text give one row each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import ALNUM, arrow_map, saved, slices, texts

WINDOW = 10
SHARD_WORDS = 200_000
MAX_COVERAGE = 0.5  # beyond this share of hit words a document is rejected, not trimmed
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Automaton:
    """All runs of words of the items, as states of equal end positions."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids)) for w in text.translate(ALNUM).split()]) for item, text in items]
        coded = [(item, words) for item, words in coded if words]
        for _, words in coded:
            end = 0
            for w in words:
                end = self.grow(end, w)
        self.least = min([window, *(len(words) for _, words in coded)])
        pairs = {a * len(self.ids) + b for _, words in coded for a, b in zip(words, words[1:])}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.owners: dict[int, set[str]] = {}  # of the window that a state holds
        whole: dict[int, list[tuple[int, str]]] = {}  # short items that end in a state
        for item, words in coded:
            at, run = 0, 0
            for w in words:
                at, run = self.step(at, run, w)
                if run >= window:
                    self.owners.setdefault(self.anchor(at), set()).add(item)
            if len(words) < window:
                whole.setdefault(at, []).append((len(words), item))
        self.short: dict[int, list[tuple[int, str]]] = {}
        if whole:
            for s in sorted(range(len(self.length)), key=self.length.__getitem__):
                found = whole.get(s, []) + (self.short.get(self.link[s], []) if s else [])
                if found:
                    self.short[s] = found

    def grow(self, end: int, word: int) -> int:
        """Add a word behind the run that state end holds; returns the new run's state."""
        known = self.next[end].get(word)
        if known is not None and self.length[known] == self.length[end] + 1:
            return known
        if known is not None:
            return self.split(end, word, known)
        new = self.state(self.length[end] + 1, {})
        while end >= 0 and word not in self.next[end]:
            self.next[end][word] = new
            end = self.link[end]
        if end < 0:
            self.link[new] = 0
        else:
            other = self.next[end][word]
            self.link[new] = other if self.length[other] == self.length[end] + 1 else self.split(end, word, other)
        return new

    def state(self, length: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.length) - 1

    def split(self, end: int, word: int, state: int) -> int:
        """Part the shorter runs of a state off into one of their own."""
        new = self.state(self.length[end] + 1, dict(self.next[state]))
        self.link[new] = self.link[state]
        self.link[state] = new
        while end >= 0 and self.next[end].get(word) == state:
            self.next[end][word] = new
            end = self.link[end]
        return new

    def step(self, at: int, run: int, word: int) -> tuple[int, int]:
        """The longest known run after one more word."""
        while (to := self.next[at].get(word)) is None and at:
            at = self.link[at]
            run = self.length[at]
        return (to, run + 1) if to is not None else (0, 0)

    def anchor(self, at: int) -> int:
        """The state of the last window words of a run."""
        while self.length[self.link[at]] >= self.window:
            at = self.link[at]
        return at

    def stretches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Where a run of the least length of interest may lie."""
        ids = np.fromiter((self.ids.get(w, -1) for w in words), np.int64, len(words))
        inside = ids >= 0
        if self.least > 1 and len(ids) > 1:
            keys = ids[:-1] * len(self.ids) + ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
            joined = inside[:-1] & inside[1:] & (self.pairs[at] == keys)
        elif self.least > 1 or not len(ids):
            return []
        else:
            joined = inside[:-1] & inside[1:]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        found = [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= self.least]
        if self.least == 1:
            near = np.zeros(len(ids) + 1, bool)
            near[:-2] |= joined
            near[1:-1] |= joined
            found += [(int(i), int(i) + 1) for i in np.flatnonzero(inside & ~near[:-1])]
        return [(a, ids[a:b].tolist()) for a, b in found]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans of word positions [start, end), merged and ordered, and the items found."""
        spans, items = [], set()
        for start, ids in self.stretches(words):
            at = run = 0
            for i, w in enumerate(ids, start + 1):
                at, run = self.step(at, run, w)
                if run >= self.window:
                    spans.append((i - run, i))
                    items |= self.owners[self.anchor(at)]
                for size, item in self.short.get(at, ()):
                    if size <= run:
                        spans.append((i - size, i))
                        items.add(item)
        return merged(spans), items


def merged(spans) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<start:bigint,end:bigint>>"


def shards(items: DataFrame, id_col: str, text_col: str):
    """The items as bounded lists, one after another."""
    clean = items.select(items[id_col].cast("string").alias("item"), items[text_col].cast("string").alias("text")).where("item is not null and text is not null")
    # A word has a byte and a gap at least, so bytes / 2 bounds the words.
    sized = saved(clean.distinct().withColumn("size", F.octet_length("text") / 2 + 1))
    total = sized.agg(F.sum("size")).first()[0] or 0
    parts = int(-(-2 * total // SHARD_WORDS))
    for part in range(parts):
        yield [(r.item, r.text.encode()) for r in sized.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).select("item", "text").collect()]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_key, n_words, spans, n_hit, items (sorted as strings)."""
    slim = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    slim = slim.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    context = docs.sparkSession.sparkContext

    def scan(rows: list[tuple[str, bytes]]) -> DataFrame:
        sent = context.broadcast(rows)

        def work(batches):
            automaton = Automaton(sent.value, window)
            for batch in slices(batches):
                lengths, spans, found = [], [], []
                for text in texts(batch.column(2)):
                    words = text.translate(ALNUM).split()
                    s, i = automaton.scan(words) if automaton.ids else ([], set())
                    lengths.append(len(words))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    found.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                    names=["doc_id", "text_key", "n_words", "spans", "items"],
                )

        return arrow_map(slim, work, f"doc_id bigint, text_key bigint, n_words bigint, spans {SPANS}, items array<string>")

    passes = [scan(rows) for rows in shards(items, item_col, text_col)] or [scan([])]
    if len(passes) == 1:
        out = passes[0]
    else:  # spans of different shards may overlap: join them by fold over the sorted list
        one = passes[0].select("doc_id", "text_key", "n_words")
        hits = passes[0].select("doc_id", "text_key", "spans", "items")
        for p in passes[1:]:
            hits = hits.union(p.select("doc_id", "text_key", "spans", "items"))
        hits = hits.where("size(spans) > 0").groupBy("doc_id", "text_key").agg(
            F.sort_array(F.flatten(F.collect_set("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
        )
        fold = f"""aggregate(spans, cast(array() as {SPANS}), (kept, s) -> if(size(kept) > 0 and s.start <= element_at(kept, -1).end,
            concat(slice(kept, 1, size(kept) - 1), array(named_struct('start', element_at(kept, -1).start, 'end', greatest(element_at(kept, -1).end, s.end)))),
            concat(kept, array(s))))"""
        hits = hits.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), F.expr(fold).alias("spans"), "items")
        out = one.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("text_key").eqNullSafe(F.col("k")), "left").select(
            "doc_id", "text_key", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")
        )
    return out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)"))


def without_spans(text: bytes, spans) -> bytes:
    """The text with the words of the spans cut out; what stands between kept words stays."""
    at = [m.span() for m in WORD.finditer(text.lower())]
    out, end = [], 0
    for s in spans:
        out.append(text[end : at[s["start"]][0]].rstrip(b" "))
        end = at[s["end"] - 1][1]
    return b"".join([*out, text[end:]])


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """The documents, all columns, with hit spans cut from the text; those hit beyond max_coverage go."""
    found = contamination(docs, items, id_col, text_col, item_col, window).where("n_hit > 0").dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "spans", (F.col("n_hit") / F.col("n_words")).alias("share"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("bigint").alias("key"), docs[text_col].cast("string").alias("text"))
    rows = rows.join(found, F.col("key").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key")), "left").where(F.coalesce("share", F.lit(0.0)) <= max_coverage)
    cut = F.pandas_udf(cut_texts, "string")
    return rows.select("row", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut("text", "spans")).alias("trimmed")).select(
        *[F.col("trimmed").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    )


def cut_texts(text, spans):
    import pandas as pd

    return pd.Series([t if s is None else without_spans(t.encode(), s).decode() for t, s in zip(text, spans)], dtype=object)
