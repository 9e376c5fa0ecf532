"""Token counts by prefix dynamic programming.

For every prefix of a text, in code points, the exact number of tokens is known,
so truncation and budget questions need no second encoding.  The counts are kept
as differences from prefix to prefix, two bytes each: their sum over the first p
differences is the count of the first p characters.

Null and empty texts have no prefixes and 0 tokens.  Special strings inside a text
count as the library counts them: each whole occurrence is one token.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalens.llm import bpe, common

LIMIT = 1024
UNIT_LIMIT = 300_000  # remembered chunks and units of text, a generation
UNIT_CHARS = 64  # longer units are not remembered

BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def tight(chunk: str) -> bool:
    core = chunk[1:] if chunk[0] in " \n" else chunk
    return core != "" and core[0] not in BLANKS and core[-1] not in BLANKS


def of_category(kind: str) -> str:
    """A character class of all code points of a general category."""
    hits = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c, before in zip(hits, [-2, *hits]) if c != before + 1]
    ends = [c for c, after in zip(hits, [*hits[1:], -2]) if c != after - 1]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in zip(starts, ends))


def unit_pattern() -> re.Pattern:
    """Pieces whose encoding depends on nothing outside them: an optional run of white
    space with the word after it.  A contraction after a space is no contraction."""
    letter, number = of_category("L"), of_category("N")
    short = f"(?:[{BLANK}]*[{BLANK.replace(' ', '')}])?'(?:[stmd]|re|ve|ll)"
    return re.compile(f"{short}|[{BLANK}]*(?:[{letter}]+|[{number}]+|[^{BLANK}{letter}{number}]+)|[{BLANK}]+")


def byte_letters() -> dict[int, str]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes, for a byte-level vocabulary file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): r for r, m in enumerate(spec["model"]["merges"])}
        self.forward = bpe.Forward(spec["model"]["vocab"], lambda a, b: ranks.get((a, b)))
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.find = unit_pattern().findall
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split if self.specials else lambda t: [t]
        self.letters = byte_letters()
        self.known, self.parts = bpe.Recent(UNIT_LIMIT), bpe.Recent(UNIT_LIMIT)

    def words(self, words: set[str]) -> dict[str, list[int]]:
        """Counts of the prefixes of pre-tokens, at the end of each code point."""
        data = {w.encode("utf-8").decode("latin-1").translate(self.letters): w for w in words}
        out = {}
        for letters, _, counts in self.forward.walk(data):
            word = data[letters]
            if len(word) == len(letters):
                out[word] = counts[1:]
            else:
                ends = accumulate(len(c.encode("utf-8")) for c in word)
                out[word] = [counts[e] for e in ends]
        return out

    def learn(self, units: list[str]) -> dict[str, bytes]:
        """The differences of units as 16-bit integers."""
        parts = {u: self.split(u) for u in units}
        needed = {p for ps in parts.values() for p in ps if p}
        needed |= {p for *_, short in parts.values() for p in ("'", short[:1]) if short}
        counts = self.words(needed)
        total = lambda *ps: sum(counts[p][-1] for p in ps if p)
        out = {}
        for unit, (blank, before, alone, core, short) in parts.items():
            base = total(before, alone)
            if not core:
                c = counts[blank]
            elif short:  # a contraction joins its letters at the end only
                c = (counts[blank] if blank else []) + [base + total("'", short[:i]) for i in range(len(short))] + [base + total(core)]
            else:
                c = (counts[blank] if blank else []) + [base + x for x in (counts[core][1:] if core[0] == " " else counts[core])]
            out[unit] = array("h", map(int.__sub__, c, [0, *c])).tobytes()
        return out

    def split(self, unit: str) -> tuple[str, ...]:
        """White space as it stands while nothing follows; its two parts once a word follows;
        the word, with the space that joins it; the letters of a contraction, and their prefixes."""
        core = unit.lstrip(BLANKS)
        blank = unit[: len(unit) - len(core)]
        if not core:
            return blank, "", "", "", ""
        if blank[-1:] == " ":
            return blank, blank[:-1], "", " " + core, ""
        if core[0] == "'" and len(core) > 1 and core[1].isalpha():
            return blank, blank[:-1], blank[-1:], core, core[1:]
        return blank, blank[:-1], blank[-1:], core, ""

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart: each begins at a single space or line end, if that is safe."""
        if "\0" in text:
            return self.find(text)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        return parts if parts[0] else parts[1:]

    def each(self, texts: list[str]) -> list[bytes]:
        """The differences of texts without special strings."""
        split = [self.chunks(t) for t in texts]
        found = set().union(*split)
        known = self.known.known(found)
        fresh = found.difference(known)
        # A chunk that begins or ends in more white space belongs together with its neighbours.
        split = [x if loose.isdisjoint(x) else self.find(t) for t, x in zip(texts, split)] if (loose := {c for c in fresh if not tight(c)}) else split
        fresh = set().union(*split).difference(known) if loose else fresh
        units = {c: self.find(c) for c in fresh}
        wanted = set().union(*units.values())
        steps = self.parts.known(wanted)
        for u, x in self.learn(list(wanted.difference(steps))).items():
            steps[u] = self.parts.put(u, x) if len(u) <= UNIT_CHARS else x
        for c, us in units.items():
            x = b"".join(map(steps.__getitem__, us))
            known[c] = self.known.put(c, x) if len(c) <= UNIT_CHARS and tight(c) else x
        return [b"".join(map(known.__getitem__, units)) for units in split]

    def plain(self, text: str) -> int:
        """The count of a text without special strings."""
        return sum(int(np.frombuffer(x, "<i2").sum()) for x in self.each([text]))

    def special(self, before: str, token: str) -> bytes:
        """A special string: its proper prefixes are ordinary text joined to what stands before."""
        units = self.find(before)
        tail = units[-1] if units else ""
        base = self.plain(tail)
        counts = [self.plain(tail + token[:i]) - base for i in range(1, len(token))]
        return np.diff([*counts, 1], prepend=0).astype("<i2").tobytes()

    def differences(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the differences of its prefix counts."""
        cut = [self.cut(t) for t in texts]
        plain = iter(self.each([p for parts in cut for p in parts[::2]]))
        out = []
        for parts in cut:
            steps = [next(plain)]
            for i in range(1, len(parts), 2):
                steps += [self.special(parts[i - 1], parts[i]), next(plain)]
            out.append(np.frombuffer(b"".join(steps), "<i2"))
        return out


def within(differences: np.ndarray, budget: int) -> int:
    """The longest prefix, in characters, of at most budget tokens."""
    if differences.sum(dtype=np.int64) <= budget:
        return len(differences)
    fits = np.flatnonzero(np.cumsum(differences, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def token_prefixes(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, keep_prefixes: bool = True
) -> DataFrame:
    """One row per text: id, n_bytes, n_tokens, over_limit, chars_within_limit, prefix_steps.

    prefix_steps holds the differences as little-endian 16-bit integers, and is null
    unless keep_prefixes.  path names a byte-level BPE file that every worker can read.
    """

    def work(batches):
        count = common.remembered(("tokens", path), lambda: PrefixCounter(path))
        for batch in common.slices(batches):
            data = common.texts(batch.column(1))
            found = count.differences([x.decode("utf-8") for x in data])
            tokens = [int(d.sum(dtype=np.int64)) for d in found]
            lengths, cuts = [len(x) for x in data], [within(d, limit) for d in found]
            steps = [d.tobytes() if keep_prefixes else None for d in found]
            columns = [batch.column(0), pa.array(lengths, pa.int64()), pa.array(tokens, pa.int64())]
            columns += [pa.array([t > limit for t in tokens], pa.bool_()), pa.array(cuts, pa.int64()), pa.array(steps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=NAMES)

    return common.arrow_map(
        df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")),
        work,
        "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, chars_within_limit bigint, prefix_steps binary",
    )


NAMES = ["doc_id", "n_bytes", "n_tokens", "over_limit", "chars_within_limit", "prefix_steps"]
