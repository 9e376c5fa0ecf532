"""Repeated lines, found by overlapping windows of three lines.

A text is cut into lines at line ends and, because prose often has a whole paragraph on
a line, after sentence ends (". ", "! ", "? ") as well.  Blank lines are passed over.
Each run of WINDOW consecutive lines is a window; a text of fewer lines is one window.
Windows of fewer than `min_words` words are passed over; the query and the pipeline ask
for 0, so none are.  The document of the smallest id keeps a window and within it
the first place; all later occurrences are covered, and the lines that any covered window
touches are removed.

Null and empty texts have no lines and stay as they are.  A null id comes after all
others.  Rows that share an id are one document: they are not compared with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import arrow_map, rolling, saved, slices, texts

WINDOW, MIN_WORDS = 3, 12


def lines(text: str) -> list[tuple[int, str]]:
    """The lines of a text with their start; blank ones are left out."""
    out, at = [], 0
    for part in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if part and not part.isspace():
            out.append((at, part))
        at += len(part) + 1
    return out


def windows(parts: list[tuple[int, str]], size: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that have words enough, and the line each begins at."""
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(p.strip()) for _, p in parts), np.uint64, len(parts))
    size = min(size, len(h))
    if not size:
        return h, np.empty(0, np.int64)
    ends = np.cumsum([0, *(len(p.split()) for _, p in parts)])
    enough = np.flatnonzero(ends[size:] - ends[:-size] >= min_words)
    return rolling(h, size)[enough], enough


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of df with two columns: row (all columns, as they came), and lines, a struct
    of text (without repeated lines), n_lines and n_removed."""
    slim = df.select(df[id_col].cast("bigint").alias("id"), df[text_col].cast("string").alias("text"))

    def post(batches):
        for batch in slices(batches):
            owners, hashes, starts, again = [], [], [], []
            for row, text in enumerate(texts(batch.column(2))):
                h, at = windows(lines(text.decode("utf-8")), size, min_words)
                repeated = np.ones(len(h), bool)
                repeated[np.unique(h, return_index=True)[1]] = False
                hashes.append(h)
                starts.append(at)
                again.append(repeated)
                owners.append(np.full(len(h), row))
            take = pa.array(np.concatenate([np.empty(0, np.int64), *owners]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(np.concatenate([np.empty(0, np.uint64), *hashes]).view(np.int64)),
                    pa.array(np.concatenate([np.empty(0, np.int64), *starts]).astype(np.int32)),
                    pa.array(np.concatenate([np.empty(0, bool), *again])),
                ],
                names=["id", "text_key", "window", "at", "again"],
            )

    posted = saved(arrow_map(slim.select("id", F.xxhash64("text").alias("text_key"), "text"), post, "id bigint, text_key bigint, window bigint, at int, again boolean"))
    places = posted.where("not again").drop("again")
    # Partial aggregates meet a window that many documents hold; adaptive joins split it.
    shared = places.groupBy("window").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").select("window", "first")
    later = places.join(shared, "window").where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "text_key", "at")
    covered = later.union(posted.where("again").select("id", "text_key", "at")).groupBy("id", "text_key").agg(F.collect_set("at").alias("covered"))
    covered = covered.withColumnRenamed("id", "covered_id").withColumnRenamed("text_key", "covered_key")
    # The text travels once, inside its row.
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id_col].cast("bigint").alias("id"), F.xxhash64(df[text_col].cast("string")).alias("text_key"))
    rows = rows.join(covered, F.col("id").eqNullSafe(F.col("covered_id")) & F.col("text_key").eqNullSafe(F.col("covered_key")), "left")
    place = df.columns.index(text_col)

    def remove(batches):
        for batch in slices(batches):
            out, totals, removed = [], [], []
            for text, starts in zip(batch.column(0).field(place).cast(pa.string()).to_pylist(), batch.column(1).to_pylist()):
                parts = lines(text or "")
                gone = np.zeros(len(parts), bool)
                for start in starts or ():
                    gone[start : start + size] = True
                totals.append(len(parts))
                removed.append(int(gone.sum()))
                out.append(without(text, parts, gone) if starts else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())], names=["text", "n_lines", "n_removed"])],
                names=["row", "lines"],
            )

    kind = rows.schema["row"].dataType.simpleString()
    return arrow_map(rows.select("row", "covered"), remove, f"row {kind}, lines struct<text:string,n_lines:bigint,n_removed:bigint>")


def without(text: str, parts: list[tuple[int, str]], gone: np.ndarray) -> str:
    """The text without the lines that go, each with the separator behind it."""
    out, at = [], 0
    for (start, part), cut in zip(parts, gone):
        if cut:
            out.append(text[at:start])
            at = start + len(part) + 1
    return "".join([*out, text[at:]]).strip() if all(gone) else "".join([*out, text[at:]])
