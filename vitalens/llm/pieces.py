"""SentencePiece encoding and decoding by a shared-prefix forward pass.

A text becomes marked words: each space is a marker, and a word is a run of markers
with the characters after it.  No piece of the vocabulary has a marker after another
character, so words are encoded alone.  The distinct new words of a batch are sorted,
which makes them a trie in depth-first order: each word keeps the forward states of
the prefix it shares with the word before, and only continues from there.

The vocabulary is a BPE one, whose encoding is not the path of the largest score.
The forward pass therefore admits only arcs that are stable under the merges (see
bpe.py); one arc per position remains, and the path equals the library's encoding.

Null and empty texts give no pieces and decode to an empty text.  A character outside
the vocabulary becomes the pieces of its UTF-8 bytes.  A marker character in a text
reads as a space, as in the library; everything else decodes to the exact text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalens.llm import bpe, common

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
WORD_LIMIT = 300_000  # words remembered within a task, a generation
WORD_CHARS = 64  # longer words are not remembered


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        kinds = [(model.is_control(i) or model.is_unknown(i), model.is_byte(i)) for i in range(len(names))]
        self.ids = {p: i for i, p in enumerate(names) if not any(kinds[i])}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(names) if kinds[i][1]}
        self.value = {i: b for b, i in self.byte.items()}
        self.surface = [b" \xe2\x81\x87 " if model.is_unknown(i) else b"" if c else bytes([self.value[i]]) if b else p.replace(MARK, " ").encode() for i, (p, (c, b)) in enumerate(zip(names, kinds))]
        scores = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.forward = bpe.Forward(self.ids, lambda a, b: scores.get(a + b))
        self.known = bpe.Recent(WORD_LIMIT)

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, by their forward states read backwards."""
        out = {}
        for word, last, _ in self.forward.walk(words):
            ids, end = [], len(word)
            while end:
                token = last[end]
                end -= len(token)
                known = self.ids.get(token)
                ids += [known] if known is not None else [self.byte[b] for b in reversed(token.encode("utf-8"))]
            out[word] = np.array(ids[::-1], "<i4").tobytes()
        return out

    def forget(self) -> None:
        """Drop what was remembered of texts; a worker that waits for other work holds the model alone."""
        self.known = bpe.Recent(WORD_LIMIT)
        self.forward.pairs.clear()

    def words(self, text: str) -> list[str]:
        """The marked words of a text."""
        marked = MARK + text.replace(" ", MARK)
        if not text:
            return []
        if "\0" in text or MARK + MARK in marked or marked[-1] == MARK:
            return WORDS.findall(marked)
        return marked.replace(MARK, "\0" + MARK).split("\0")[1:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        found = set().union(*split)
        known = self.known.known(found)
        for w, x in self.learn(list(found.difference(known))).items():
            known[w] = self.known.put(w, x) if len(w) <= WORD_CHARS else x
        return [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in split]

    def decode(self, ids) -> str:
        """The text of any sequence of ids; bytes that are no UTF-8 become U+FFFD each."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if len(ids) and data[:1] == b" " and not self.value.get(int(ids[0])) and self.surface[int(ids[0])] != b" \xe2\x81\x87 ":
            data = data[1:]
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("utf-8", errors="pieces.each")


def _each(error: UnicodeDecodeError):
    return "�", error.start + 1


def pieces(path: str) -> Pieces:
    import codecs

    codecs.register_error("pieces.each", _each)
    return common.remembered(("pieces", path), lambda: Pieces(path))


SCHEMA = "doc_id bigint, n_pieces bigint, piece_ids array<int>, decoded string, exact boolean"


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, n_pieces, piece_ids, decoded, exact (decoded equals the text)."""

    def work(batches):
        model = pieces(path)
        try:
            for batch in common.slices(batches):
                texts = [t.decode("utf-8") for t in common.texts(batch.column(1))]
                ids = model.encode(texts)
                back = [model.decode(i.tolist()) for i in ids]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *ids]), pa.int32())
                )
                same = pa.array([a == b for a, b in zip(texts, back)], pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), lists, pa.array(back, pa.string()), same],
                    names=["doc_id", "n_pieces", "piece_ids", "decoded", "exact"],
                )
        finally:
            model.forget()

    return common.arrow_map(df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")), work, SCHEMA)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """One row per sequence of ids: doc_id, decoded; null ids decode to an empty text."""

    def work(batches):
        model = pieces(path)
        for batch in batches:
            back = [model.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["doc_id", "decoded"])

    return common.arrow_map(df.select(df[id_col].cast("bigint").alias("doc_id"), df[ids_col].cast("array<int>").alias("piece_ids")), work, "doc_id bigint, decoded string")
