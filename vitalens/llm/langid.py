"""Language identification by character models.

One interpolated Kneser-Ney model of ORDER characters per language, over letters in
lower case with each run of other characters as one space.  Its logarithms lie in
arrays sorted by the hash of the n-gram, one column per language, so a character costs
one lookup whatever the number of languages.  The language of the lowest cross-entropy
per character wins.

Counts, continuation counts, discounts and probabilities are taken by Spark over all rows
with a language; no n-gram and no language is left out.  The result is one table sorted by
hash in files of the shared folder.  Tasks hold LOADED values of it at a time: a model of
more is read file after file for each CHUNK of characters.  The driver knows the files and
the languages only.  The scale of the score and the levels of rejection are fitted on all
different texts of those rows; identified() measures every text once for both.

Texts that are null or have no letter get UNKNOWN with score 0.  If nothing can be learned
every text gets it.  Ties go to the language that sorts first.
"""

from __future__ import annotations

import pickle
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import arrow_map, mixed, numbered, remembered, saved, slices, texts

ORDER = 5
FILE_ROWS, LOADED, CHUNK = 100_000, 16_000_000, 4_000_000  # rows of a file; values held by a task; characters times languages
HASH_BITS = 59  # a code is the kind of a row (n of an n-gram, ORDER + n of its context) and so many bits of its hash
REJECTED = 0.001  # share of a language's own texts that its level rejects
UNKNOWN = "und"
STEPS = mixed(np.arange(101, 101 + ORDER, dtype=np.uint64)) | np.uint64(1)


def letters() -> np.ndarray:
    """For each code point the lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def spelled(text: bytes) -> np.ndarray:
    """The characters of a text as the models read them, without outer spaces."""
    table = remembered(("langid", "letters"), letters)
    x = table[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)]
    blank = x == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    x = x[keep]
    return x[int(len(x) > 0 and x[0] == 32) : len(x) - int(len(x) > 1 and x[-1] == 32)]


def padded(x: np.ndarray) -> np.ndarray:
    space = np.full(ORDER - 1, 32, np.uint32)
    return np.concatenate([space, x, space[:1]])


def hashed(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-grams, by the place of their last character first."""
    size = len(x) - n + 1
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out += x[j : j + size].astype(np.uint64) * STEPS[j]
    return out * np.uint64(0x9E3779B97F4A7C15)


def counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the highest order over docs (lang, text)."""

    def work(batches):
        for batch in slices(batches):
            grouped = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                x = spelled(text)
                if len(x):
                    grouped[lang].append(padded(x))
            for lang, parts in grouped.items():
                x = np.concatenate(parts)
                # No n-gram reaches over the end of a text.
                within = np.concatenate([np.arange(len(part) - ORDER + 1) + at for part, at in zip(parts, np.cumsum([0, *(len(part) for part in parts)]))])
                _, first, n = np.unique(hashed(x, ORDER)[within], return_index=True, return_counts=True)
                grams = [x[i : i + ORDER].tobytes().decode("utf-32-le") for i in within[first]]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    return arrow_map(docs, work, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Sorted:
    """A table of hashes in order with a row of values each, entered through its leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.uint64(2**64 - 1))
        self.values = np.concatenate([values[order], np.zeros((1, values.shape[1]))]).astype(np.float32)
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.keys[:-1], np.arange(2**bits, dtype=np.uint64) << self.shift)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash is, and whether it is there."""
        at = self.start[h >> self.shift]
        below = np.flatnonzero(self.keys[at] < h)
        while len(below):
            at[below] += 1
            below = below[self.keys[at[below]] < h[below]]
        return at, self.keys[at] == h


class Model:
    """The tables of all languages in one process, made from the counts of the highest order: what
    tables_of makes in Spark, for few counts."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        by_lang: dict[str, dict[str, int]] = defaultdict(dict)
        for lang, gram, n in rows:
            by_lang[lang][gram] = n
        self.langs = sorted(by_lang)
        self.floor = float(-np.log(1 + len({g[-1] for _, g, _ in rows})))
        grams = [[dict(by_lang[x]) for x in self.langs]]
        for n in range(ORDER - 1, 0, -1):  # of how many characters a shorter n-gram is the continuation
            shorter = []
            for longer in grams[0]:
                c: dict[str, int] = defaultdict(int)
                for g in longer:
                    c[g[1:]] += 1
                shorter.append(c)
            grams.insert(0, shorter)
        width = len(self.langs)
        row, lower = {"": 0}, np.full((1, width), np.exp(self.floor))
        self.tables, self.backoffs = [], []
        for per_lang in grams:
            every = sorted(set().union(*per_lang))
            contexts = sorted({g[:-1] for g in every})
            place = {c: i for i, c in enumerate(contexts)}
            at = np.array([place[g[:-1]] for g in every])
            p, weight = np.zeros((len(every), width)), np.ones((len(contexts), width))
            for column, c in enumerate(per_lang):
                n = np.array([c.get(g, 0) for g in every], np.float64)
                ones, twos = (n == 1).sum(), (n == 2).sum()
                discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, n > 0, len(contexts))
                seen = total > 0
                weight[seen, column] = discount * kinds[seen] / total[seen]
                p[:, column] = np.maximum(n - discount, 0) / np.maximum(total[at], 1)
            p += weight[at] * lower[[row[g[1:]] for g in every]]
            row, lower = {g: i for i, g in enumerate(every)}, p
            self.tables.append(Sorted(self.hashes(every), np.log(p)))
            self.backoffs.append(Sorted(self.hashes(contexts), np.log(weight)))

    @staticmethod
    def hashes(grams: list[str]) -> np.ndarray:
        n = len(grams[0])
        if not n:
            return np.zeros(len(grams), np.uint64)
        x = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(len(grams), n)
        out = np.full(len(grams), n, np.uint64)
        for j in range(n):
            out += x[:, j].astype(np.uint64) * STEPS[j]
        return out * np.uint64(0x9E3779B97F4A7C15)

def loaded(uris: tuple[str, ...], width: int) -> dict[int, Sorted]:
    """Files of the sorted table as one table for each kind of row."""
    import pyarrow.fs
    import pyarrow.parquet

    codes, values = [], []
    for uri in uris:
        store, path = pyarrow.fs.FileSystem.from_uri(uri)
        with store.open_input_file(path) as file:
            rows = pyarrow.parquet.read_table(file)
        codes.append(rows["code"].to_numpy().astype(np.uint64))
        values.append(np.concatenate([np.empty(0, np.float32), *(c.flatten().to_numpy() for c in rows["value"].chunks)]).reshape(-1, width))
    code, value = np.concatenate(codes), np.concatenate(values)
    kinds = (code >> np.uint64(HASH_BITS)).astype(np.int64)
    return {int(k): Sorted(code[kinds == k] << np.uint64(64 - HASH_BITS), value[kinds == k]) for k in np.unique(kinds)}


class Scorer:
    """The model as files; (uri, first code, last code) in order, put together to groups a task can hold."""

    def __init__(self, langs: list[str], floor: float, files: list[tuple[str, int, int, int]]):
        self.langs, self.floor, self.groups = langs, floor, []
        size = LOADED
        for uri, low, high, rows in files:
            if size + rows * len(langs) > LOADED:
                self.groups.append(([], low, high))
                size = 0
            size += rows * len(langs)
            uris, first, _ = self.groups[-1]
            self.groups[-1] = ([*uris, uri], first, high)

    def find(self, kind: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are there, and the values of those."""
        h = h & ~np.uint64(2 ** (64 - HASH_BITS) - 1)
        there, out = np.zeros(len(h), bool), np.zeros((len(h), len(self.langs)), np.float32)
        for uris, low, high in self.groups:
            if not low >> HASH_BITS <= kind <= high >> HASH_BITS:
                continue
            kept = remembered(("langid", "group"), dict)  # one group at a time
            if (key := tuple(uris)) not in kept:
                kept.clear()
                kept[key] = loaded(key, len(self.langs))
            at, found = kept[key][kind].find(h)
            out[found] = kept[key][kind].values[at[found]]
            there |= found
        return there, out[there]

    def entropies(self, read: list[np.ndarray]) -> np.ndarray:
        """The mean log probability of a character of each text under each language."""
        total = np.zeros((len(read), len(self.langs)))
        start, sizes = 0, [len(x) * len(self.langs) for x in read]
        while start < len(read):
            end, size = start + 1, sizes[start]
            while end < len(read) and size + sizes[end] <= CHUNK:
                size += sizes[end]
                end += 1
            total[start:end] = self.sums(read[start:end])
            start = end
        return total / np.array([len(x) + 1 for x in read], np.float64).reshape(-1, 1)

    def sums(self, read: list[np.ndarray]) -> np.ndarray:
        parts = [padded(x) for x in read]
        text, owner = np.concatenate(parts).astype(np.uint64), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
        todo = np.concatenate([np.arange(ORDER - 1, len(x)) + at for x, at in zip(parts, np.cumsum([0, *(len(x) for x in parts)]))])
        total = np.zeros((len(read), len(self.langs)))

        def add(places: np.ndarray, values: np.ndarray) -> None:
            for column in range(len(self.langs)):
                total[:, column] += np.bincount(owner[places], values[:, column], len(read))

        def before(places: np.ndarray, n: int, last: int) -> np.ndarray:
            """Hashes of the n characters of which the last is so far behind each place."""
            out = np.full(len(places), n, np.uint64)
            for j in range(n):
                out += text[places - last - n + 1 + j] * STEPS[j]
            return out * np.uint64(0x9E3779B97F4A7C15)

        for n in range(ORDER, 0, -1):
            there, values = self.find(n, before(todo, n, 0))
            add(todo[there], values)
            todo = todo[~there]
            if not len(todo):
                return total
            # Before the first character comes the empty context, which is always there.
            there, values = self.find(ORDER + n, before(todo, n - 1, 1) if n > 1 else np.zeros(len(todo), np.uint64))
            add(todo[there], values)
        add(todo, np.full((len(todo), len(self.langs)), self.floor))  # characters of no language
        return total


def tables_of(grams: DataFrame) -> Scorer | None:
    """The model of the counts (lang, gram, n) of the highest order, computed and kept in tables."""
    langs = sorted(r.lang for r in grams.select("lang").distinct().collect())
    if not langs:
        return None
    every = range(len(langs))
    per_lang = lambda make: F.array(*[make(i) for i in every])
    dense = grams.groupBy("gram").agg(per_lang(lambda i: F.sum(F.when(F.col("lang") == langs[i], F.col("n")).otherwise(0)).cast("double")).alias("n"))
    orders = {ORDER: saved(dense)}
    for n in range(ORDER - 1, 0, -1):  # of how many characters a shorter n-gram is the continuation
        shorter = orders[n + 1].groupBy(F.substring("gram", 2, n).alias("gram"))
        orders[n] = saved(shorter.agg(per_lang(lambda i: F.count_if(F.col("n")[i] > 0).cast("double")).alias("n")))
    floor = float(-np.log(1 + orders[1].count()))
    known, p = [], None
    for n in range(1, ORDER + 1):
        seen = orders[n].agg(*[F.count_if(F.col("n")[i] == k).alias(f"n{k}_{i}") for i in every for k in (1, 2)]).first()
        ones, twos = ([seen[f"n{k}_{i}"] for i in every] for k in (1, 2))
        discount = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in zip(ones, twos)]
        rows = orders[n].withColumn("context", F.substring("gram", 1, n - 1))
        contexts = rows.groupBy("context").agg(per_lang(lambda i: F.sum(F.col("n")[i])).alias("total"), per_lang(lambda i: F.count_if(F.col("n")[i] > 0)).alias("kinds"))
        weight = per_lang(lambda i: F.when(F.col("total")[i] > 0, discount[i] * F.col("kinds")[i] / F.col("total")[i]).otherwise(1.0))
        contexts = saved(contexts.select("context", "total", weight.alias("weight")))
        rows = rows.join(contexts, "context")
        if p is None:
            rows = rows.withColumn("lower", F.array(*[F.lit(float(np.exp(floor)))] * len(langs)))
        else:
            rows = rows.join(p.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), F.substring("gram", 2, n - 1) == F.col("shorter"))
        own = lambda i: F.greatest(F.col("n")[i] - discount[i], F.lit(0.0)) / F.greatest(F.col("total")[i], F.lit(1.0))
        p = saved(rows.select("gram", per_lang(lambda i: own(i) + F.col("weight")[i] * F.col("lower")[i]).alias("p")))
        known.append(p.select(F.lit(n).alias("kind"), "gram", F.transform("p", F.ln).alias("value")))
        known.append(contexts.select(F.lit(ORDER + n).alias("kind"), F.col("context").alias("gram"), F.transform("weight", F.ln).alias("value")))

    def code(batches):
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            for kind in np.unique(kinds):
                rows = batch.filter(pa.array(kinds == kind))
                h = Model.hashes(rows.column(1).to_pylist()) >> np.uint64(64 - HASH_BITS)
                codes = h | np.uint64(kind) << np.uint64(HASH_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), rows.column(2)], names=["code", "value"])

    every_row = known[0]
    for rows in known[1:]:
        every_row = every_row.union(rows)
    coded = saved(arrow_map(every_row.select("kind", "gram", F.transform("value", lambda v: v.cast("float")).alias("value")), code, "code bigint, value array<float>"))
    table = saved(coded.repartitionByRange(max(16, coded.count() // FILE_ROWS), "code").sortWithinPartitions("code"))
    files = table.groupBy(F.input_file_name().alias("uri")).agg(F.min("code").alias("low"), F.max("code").alias("high"), F.count("*").alias("n"))
    return Scorer(langs, floor, sorted(map(tuple, files.collect()), key=lambda f: f[1]))


def measured(df: DataFrame, model: Scorer) -> DataFrame:
    """df (doc_id, lang, learn, text) as doc_id, lang, learn, k (hash of the text) and values, null without letters."""
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))  # with its code, as workers lack it

    def work(batches):
        known = pickle.loads(sent.value)
        for batch in slices(batches):
            read = [spelled(t) for t in texts(batch.column(4))]
            found = iter(known.entropies([x for x in read if len(x)]).tolist())
            found = [next(found) if len(x) else None for x in read]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "lang", "learn", "k", "values"])

    return arrow_map(df.select("doc_id", "lang", "learn", F.xxhash64("text").alias("k"), "text"), work, "doc_id bigint, lang string, learn boolean, k bigint, values array<double>")


def fitted(tried: DataFrame, langs: list[str]) -> tuple[float, np.ndarray]:
    """The scale of the score and the levels of rejection by all of tried (lang, values).

    The scale is the factor on mean log probabilities whose softmax explains the true languages
    best; a level is the quantile REJECTED of a language's own texts, between its two nearest ones.
    """
    truth = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int")
    tried = saved(tried.withColumn("own", F.get("values", truth - 1)).where("own is not null"))
    factors = (2.0 ** np.arange(-2, 9)).tolist()
    top = F.array_max("values")
    spread = lambda s: F.aggregate("values", F.lit(0.0), lambda acc, v: acc + F.exp(s * (v - top)))
    sums = tried.agg(*[F.sum(s * (F.col("own") - top) - F.ln(spread(s))) for s in factors]).first()
    factor = factors[int(np.argmax(sums))] if sums[0] is not None else 10.0
    sizes = {r.lang: r["count"] for r in tried.groupBy("lang").count().collect()}
    wanted, before = {}, 0
    for lang in sorted(sizes, key=lambda x: x.encode()):
        at = (sizes[lang] - 1) * REJECTED
        wanted[lang] = before + 1 + int(at), before + 1 + min(int(at) + 1, sizes[lang] - 1), at - int(at)
        before += sizes[lang]
    places = sorted({p for low, high, _ in wanted.values() for p in (low, high)})
    own = {r.number: r.own for r in numbered(tried.select("lang", "own"), ["lang", "own"]).where(F.col("number").isin(places)).collect()} if places else {}
    levels = [own[low] + (own[high] - own[low]) * part for low, high, part in (wanted[x] for x in langs if x in wanted)]
    levels = iter(levels)
    return factor, np.array([next(levels) if x in wanted else -np.inf for x in langs])


def model_of(labelled: DataFrame) -> tuple | None:
    """(model, scale, levels) learned from labelled (lang, text); None if there is nothing to learn."""
    labelled = labelled.where("lang is not null").select(F.lit(None).cast("bigint").alias("doc_id"), "lang", F.lit(True).alias("learn"), "text")
    model = tables_of(saved(counts(labelled.select("lang", "text"))))
    return model and (model, *fitted(learned_values(measured(labelled, model)), model.langs))


def learned_values(values: DataFrame) -> DataFrame:
    """One row for each different text of a language that was learned from."""
    return values.where("learn and lang is not null and values is not null").select("lang", "k", "values").distinct()


def decided(values: list, learned: tuple | None) -> tuple[list, list, list]:
    """Language, score and acceptance for the mean log probabilities of texts, None without letters."""
    langs, scores, accepted = [], [], []
    for v in values:
        if v is None:
            langs.append(UNKNOWN)
            scores.append(0.0)
            accepted.append(False)
            continue
        model, factor, levels = learned
        v = np.asarray(v)
        best = int(np.argmax(v))
        langs.append(model.langs[best])
        scores.append(float(1 / np.exp(factor * (v - v[best])).sum()))
        accepted.append(bool(v[best] >= levels[best]))
    return langs, scores, accepted


PREDICTED = "doc_id bigint, lang_pred string, score double, accepted boolean"


def verdicts(ids: pa.Array, found: tuple[list, list, list]) -> pa.RecordBatch:
    langs, scores, accepted = found
    return pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])


def predict(df: DataFrame, learned: tuple | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id, lang_pred, score (0 to 1), accepted (not rejected as foreign to all)."""
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps(learned))  # with its code, as workers lack it

    def work(batches):
        given = pickle.loads(sent.value)
        for batch in batches:
            read = [spelled(text) if given else () for text in texts(batch.column(1))]
            values = iter(given[0].entropies([x for x in read if len(x)]) if given else ())
            yield verdicts(batch.column(0), decided([next(values) if len(x) else None for x in read], given))

    return arrow_map(df.select(df[id_col].cast("bigint").alias("doc_id"), df[text_col].cast("string").alias("text")), work, PREDICTED)


def identified(df: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of predict() for all of df, with what is learned from its rows where learn holds and that have a language.

    Every text is measured once, for the fit and for its own prediction."""
    docs = df.select(df[id_col].cast("bigint").alias("doc_id"), df[lang_col].alias("lang"), F.coalesce(learn, F.lit(False)).alias("learn"), df[text_col].cast("string").alias("text"))
    model = tables_of(saved(counts(docs.where("learn and lang is not null").select("lang", "text"))))
    if model is None:
        return predict(docs, None)
    values = saved(measured(docs, model))
    sent = df.sparkSession.sparkContext.broadcast(cloudpickle.dumps((model, *fitted(learned_values(values), model.langs))))

    def work(batches):
        given = pickle.loads(sent.value)
        for batch in batches:
            yield verdicts(batch.column(0), decided(batch.column(1).to_pylist(), given))

    return arrow_map(values.select("doc_id", "values"), work, PREDICTED)
