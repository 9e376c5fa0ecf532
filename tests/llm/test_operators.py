"""The training-data operators against brute force, and on nulls, empties, long texts and repeats."""

import html
import itertools
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vitalens.llm import ann, contamination, langid, licenses, linedup, neardup, pieces, quality, queries, tokens, wrappers
from vitalens.llm.common import table

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in "ba co di fu ge ha jo ki lu me".split() for b in "n r s t x".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


BASE = prose(1, 120)
ROWS = [
    (1, BASE),
    (1, BASE),  # a repeated row
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (5, BASE),  # an exact copy
    (6, BASE.replace(" ", "  ", 3)),  # the same words
    (7, " ".join(BASE.split()[:-2] + ["other", "end"])),  # a near copy
    (8, prose(2, 30_000)),  # very long
    (9, "x" * 20_000),
    (10, "two words"),
    (11, "Zoë's naïve 漢字 🙂 <|endoftext|> MIT License"),
    (None, prose(3, 60)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases, with columns named like those the operators make."""
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    clash = "id row text_key n_tokens n_words keep score lang_pred window class token spans covered".split()
    return df.withColumns({c: F.lit(None).cast("string") for c in clash}).withColumn("n_chars", F.length("text").cast("bigint"))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())


# --- token counts ----------------------------------------------------------------------------


def test_token_counts_of_all_prefixes():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own, r = Tokenizer.from_file(path), tokens.PrefixCounter(path), random.Random(5)
    bits = [*"aehtdlrsv'' \n\t  .,!-=1é漢ß<|> 　\r²½_", "<|endoftext|>", "don't", "'ll", "'re", "🙂", "\x1c"]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 20)))
        d = own.differences([text])[0]
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(1, len(text) + 1)]
        assert d.cumsum().tolist() == want, text
        for budget in (0, 1, 3, 100):
            assert tokens.within(d, budget) == max([0, *(i for i, n in enumerate(want, 1) if n <= budget)])


def test_token_rows(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = tokens.token_prefixes(docs, path).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.token_prefixes(empty, path).count() == 0


# --- pieces ------------------------------------------------------------------------------------


def test_pieces_equal_the_library(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own, r = pieces.pieces(path), random.Random(6)
    for _ in range(200):
        text = "".join(r.choice([*"aeht ▁\n 漢ßé①\x00", "  ", "🙂", "tion"]) for _ in range(r.randint(0, 20)))
        assert own.encode([text])[0].tolist() == library.encode(text)
        ids = [r.choice([r.randrange(32000), r.randrange(259)]) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids)
    got = pieces.encode(docs, path)
    assert sorted(map(str, [(i, library.encode(t or "")) for i, t in ROWS])) == sorted(str((x.doc_id, x.piece_ids)) for x in got.collect())
    assert got.where("not exact").count() == 0
    assert pieces.decode(got, path).join(got.select("doc_id", F.col("decoded").alias("d")), "doc_id").where("d <> decoded").count() == 0
    assert pieces.encode(empty, path).count() == 0


# --- near duplicates ---------------------------------------------------------------------------


def components_by_force(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(s), root[i]) for i, s in sets.items()}


def test_near_duplicates_on_edges(docs, empty):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == components_by_force(ROWS)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert neardup.near_duplicates(empty).count() == 0


def test_near_duplicates_in_a_group_of_distant_copies(spark):
    r, rows = random.Random(7), []
    for i in range(60):  # edits of one text: some pairs link, most do not
        w = BASE.split()
        for _ in range(i % 6):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == components_by_force(rows)


# --- language ------------------------------------------------------------------------------------


def test_language_held_out(spark, docs, empty):
    data = table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.op4_language(spark, "/root/testdata/sf0.01").join(data.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    learned = langid.model_of(data.select("lang", "text"))
    out = {r.doc_id: r for r in langid.predict(docs, learned).collect()}
    assert [out[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and out[10].lang_pred != "und"
    assert langid.predict(empty, learned).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.model_of(data.select("lang", "text").limit(0))).collect()} == {"und"}


def test_language_model_sums_to_one():
    grams = Counter()
    for t in ("abracadabra", "banana", "cabbage"):
        x = " " * 4 + t + " "
        grams.update(x[i : i + 5] for i in range(len(x) - 4))
    model = langid.Model([("aa", g, n) for g, n in grams.items()])
    import numpy as np

    total = np.exp(model.tables[0].values[:-1]).sum()
    assert 0.8 < total <= 1.0001  # the rest is kept for unseen characters


def test_language_model_is_whole(spark):
    import numpy as np

    r = random.Random(11)
    rows = [(lang, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(90))) for lang in ("aa", "bb") for _ in range(1500)]
    grams = {}
    for lang, t in rows:
        x = " " * 4 + " ".join(t.split()) + " "
        grams.setdefault(lang, Counter()).update(x[i : i + 5] for i in range(len(x) - 4))
    want = langid.Model([(lang, g, n) for lang, c in grams.items() for g, n in c.items()])
    assert len(want.tables[4].keys) > 200_001
    model, _, _ = langid.model_of(spark.createDataFrame(rows, "lang string, text string"))
    uris = tuple(u for us, _, _ in model.groups for u in us)
    got, low = langid.loaded(uris, 2), np.uint64(2**64 - 2 ** (64 - langid.HASH_BITS))
    assert (model.langs, model.floor) == (want.langs, want.floor)
    for n in range(1, 6):
        for kind, table_ in ((n, want.tables[n - 1]), (5 + n, want.backoffs[n - 1])):
            assert (got[kind].keys[:-1] == table_.keys[:-1] & low).all()
            assert np.allclose(got[kind].values, table_.values, atol=1e-4)
    # The same scores when a task cannot hold all of it.
    read = [langid.spelled(t.encode()) for t in ("banana split", rows[0][1], "é", "x")]
    parts = langid.Scorer(model.langs, model.floor, [])
    parts.groups = [([u], *bounds(u)) for u in uris]
    assert len(parts.groups) >= 16 and np.allclose(model.entropies(read), parts.entropies(read))


def bounds(uri):
    import pyarrow.parquet as pq

    codes = pq.read_table(uri.removeprefix("file://"))["code"].to_pylist()
    return min(codes), max(codes)


def test_language_has_no_limit_of_languages(spark):
    rows = [(f"l{i:02}", f"{WORDS[i % 50]}{WORDS[i // 50]} {WORDS[(7 * i) % 50]} " * 4) for i in range(70)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, lang string, text string")
    learned = langid.model_of(df.select("lang", "text"))
    assert all(r.lang_pred == f"l{r.doc_id:02}" for r in langid.predict(df, learned).collect())


# --- licenses ------------------------------------------------------------------------------------


def test_license_places_by_force(spark, docs):
    texts = [*ROWS, (20, "the MIT license, mit LICENSE and gnu General Public License"), (21, licenses.TEXTS[3][1]), (22, licenses.TEXTS[0][1].replace("merge", "merge, oh well,"))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = licenses.scan(df).collect()
    assert len(got) == len(texts)
    known = [(p.encode().split(), label) for p, label in licenses.PHRASES]
    want = [(i, len(w := words(t)), sorted((at, label) for p, label in known for at in range(len(w)) if w[at : at + len(p)] == p)) for i, t in texts]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, [tuple(p) for p in r.places])) for r in got)
    spans = {r.doc_id: [s.label for s in r.spans] for r in got}
    assert "bsd" in spans[21] and "mit" in spans[22] and spans[8] == []


# --- contamination ---------------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [200_000, 40])
def test_contamination_by_force(spark, docs, monkeypatch, shard):
    monkeypatch.setattr(contamination, "SHARD_WORDS", shard)
    items = [(1, prose(1, 40)), (2, prose(8, 25)), (3, "two words"), (4, "banx"), (5, None), (6, ""), (7, "x y z x y z x y z x y z"), (None, BASE), (2, prose(9, 15))]
    texts = [*ROWS, (30, "a " + prose(8, 25) + " b two words banx"), (31, "x y z " * 8), (32, prose(9, 14))]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = contamination.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        want.append((i, len(w), len(hit), sorted(found)))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_words, r.n_hit, r["items"])) for r in got)


def test_spans_are_cut(spark):
    df = spark.createDataFrame([(1, "Keep this. " + prose(8, 25) + " And that."), (2, prose(8, 25))], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, prose(8, 25))], "item_id bigint, text string")
    out = {r.doc_id: r.text for r in contamination.decontaminated(df, items, max_coverage=0.95).collect()}
    assert out == {1: "Keep this. And that."}
    assert contamination.decontaminated(df, items.limit(0)).count() == 2


# --- pages -----------------------------------------------------------------------------------------

PAGE = (
    "<html><head><title>x</title></head><body><header>Site</header><nav><ul><li>a</ul></nav><div class='cookie-notice'>ok?</div>"
    "<main><article class=post><h1>H {0}</h1><p>By our staff<p>One&nbsp;two {0} &amp; <b>th</b>ree<br>x<div class=ad>buy</div>"
    "<form>f</form><section class='comments'><p>nice</p></section></article><aside>rel</aside></main><footer>f</footer>"
)


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.format(i)) for i in range(6)] + [(10, "http://b.example/", None), (11, None, ""), (12, "http://c.example", "<p>cut off <b"), (6, "http://a.example/0", PAGE.format(0))]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(1))).collect()}
    assert got[3] == "H 3\n\nOne two 3 & three x"  # the line that all pages have is template
    assert got[10] == "" and got[11] == "" and got[12].startswith("cut off") and got[6] == got[0]


def test_given_pages_against_a_plain_reading(spark):
    got = {r.page_id: r.text for r in queries.op7_main_text(spark, SF).collect()}
    for x in table(spark, SF, "pages").collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", x.html or "", re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", re.sub(r"<br>", " ", inner[1] if inner else "")))
        assert got[x.page_id] == "\n\n".join(t for p in parts if (t := " ".join(html.unescape(p).split())))


def test_all_content_of_a_page_is_read():
    two = "<main><article><p>first part of it</p></article><div class=ad>buy</div><article><h2>Two</h2><p>second</p></article></main>"
    assert wrappers.main_text(two, None) == "first part of it\n\nTwo\n\nsecond"
    teaser = "<main><h1>Head</h1><p>the long text of the page</p><article class=teaser><p>card</p></article><p>and its end</p></main>"
    assert wrappers.main_text(teaser, None) == "Head\n\nthe long text of the page\n\ncard\n\nand its end"
    beside = "<main><p>the long text of the page</p></main><article class=teaser><p>card</p></article>"
    assert wrappers.main_text(beside, None) == "the long text of the page"


def test_constants_are_counted_over_all_pages_of_a_host(spark):
    # Twelve of 400 pages have a layout of their own; one class name is made for each page.
    def page(i):
        if i % 33 == 0:
            return f"<body><article class='post-{i}'><h2>Review {i}</h2><div class='tail'><p>Rated by our team</p><p>body {i}</p></div></article></body>"
        return f"<body><article><div><p>text {i}</p><p>Thanks for reading</p></div></article></body>"

    # On 300 of 400 pages, too few for a constant, whatever pages a sample holds.
    def often(i):
        return f"<body><article><div><p>text {i}</p>{'<p>Often</p>' if i % 4 else ''}</div></article></body>"

    rows = [(i, f"https://a.example/{i}", page(i)) for i in range(397)] + [(1000 + i, f"https://b.example/{i}", often(i)) for i in range(400)]
    rows += [(3000, "https://c.example/1", None), (3001, None, "<p>alone</p>")]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[0] == "Review 0\n\nRated by our team\n\nbody 0"  # its class names make it a page alone
    assert got[1] == "text 1" and got[396].endswith("body 396")
    assert all(got[1000 + i] == (f"text {i}\n\nOften" if i % 4 else f"text {i}") for i in range(400))
    assert got[3000] == "" and got[3001] == "alone"
    rare = [(i, f"https://a.example/{i}", page(i).replace(f"post-{i}", "post")) for i in range(397)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rare, "page_id bigint, url string, html string")).collect()}
    assert got[33] == "Review 33\n\nbody 33" and got[2] == "text 2"


def test_wrappers_of_groups_are_folded_in_turn(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "FOLDED", 3)
    kinds = ["h2", "h3", "ul", "ol", "pre"]
    body = lambda i: "".join(f"<{k}>{k} {i}</{k}>" for j, k in enumerate(kinds) if i >> j & 1)
    rows = [(i, "https://a.example/", f"<article>{body(i)}<p>end {i}</p><div>Fixed</div></article>") for i in range(128)]
    got = {r.page_id: r.text for r in wrappers.main_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(t.endswith(f"end {i}") for i, t in got.items())


# --- quality ---------------------------------------------------------------------------------------


def test_quality_parts_good_from_bad(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, d).join(table(spark, d, "labels"), "doc_id").collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_quality_on_edges(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (8, 0), (None, 1), (5, None)], "doc_id bigint, quality int")
    got = quality.resampled(docs, labels).select("row.doc_id", "log_weight", "keep").collect()
    assert len(got) == len(ROWS)
    assert all(r.log_weight is None and not r.keep for r in got if r.doc_id in (2, 3, 4))
    free = quality.resampled(docs, labels.limit(0)).select("row.doc_id", "keep").collect()
    assert {r.doc_id for r in free if not r.keep} == {2, 3, 4}
    assert quality.resampled(empty, labels).count() == 0


def test_kth_largest(spark):
    values = [random.Random(3).gauss(0, 5) for _ in range(3000)] + [1.0] * 50
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 10, 1500, 3050):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]


# --- lines -----------------------------------------------------------------------------------------


def test_lines_by_force(docs, empty):
    got = linedup.dedup_lines(docs).select("row.doc_id", "lines.*").collect()
    assert len(got) == len(ROWS)

    def cut(t):
        return [p.strip() for p in (t or "").replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n") if p.strip()]

    first, want = {}, []
    for i, t in sorted(set(ROWS), key=lambda r: (r[0] is None, r[0] or 0)):
        parts, gone = cut(t), set()
        k = min(3, len(parts))
        for at in range(len(parts) - k + 1 if parts else 0):
            window = tuple(parts[at : at + k])
            if sum(len(p.split()) for p in window) >= 12:
                if window in first:
                    gone.update(range(at, at + k))
                first.setdefault(window, i)
        want.append((i, len(parts), len(gone), [p for j, p in enumerate(parts) if j not in gone]))
    assert sorted(map(str, want)) == sorted({str((r.doc_id, r.n_lines, r.n_removed, cut(r.text))) for r in got})
    assert {r.text for r in got if r.doc_id == 2} == {None}
    assert linedup.dedup_lines(empty).count() == 0


def test_short_and_unspaced_windows_go(spark, tmp_path):
    rows = [(1, "Yes. No. Maybe. First own line here."), (2, "Second own line here.\nYes. No. Maybe."), (3, "今天天气很好\n我们去公园\n然后回家\n第三"), (4, "第四\n今天天气很好\n我们去公园\n然后回家"), (5, "one\none\none\none")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: rows[0][1], 2: "Second own line here.", 3: rows[2][1], 4: "第四", 5: "one"}
    assert {r.doc_id: r.text.strip() for r in queries.op9_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text.strip() for r in corpus_pipeline.line_stage(spark, df, SF).collect()} == want


# --- vectors ---------------------------------------------------------------------------------------


def test_nearest_vectors(spark):
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)], 0) for i in range(300)]
    rows += [(i, rows[7][1], 0) for i in range(300, 340)]  # many equal vectors
    odd = [(400, None, 0), (401, [0.0] * 6, 0), (402, [float("nan")] * 6, 0), (403, [1.0, None] * 3, 0), (404, [], 0), (450, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, rank int")
    got = defaultdict(list)
    for x in ann.nearest(df, df.where("vec_id % 50 = 0")).orderBy("rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    hits = total = 0
    for i, v, _ in rows:
        if i % 50 == 0:
            order = sorted((-round(ann.cosine(v, w), 12), j) for j, w, _ in rows if j != i)[:5]
            hits += len({j for _, j in order} & {j for j, _ in got[i]})
            total += 5
    assert hits >= 0.9 * total and 450 not in got and set(got) == {i for i, *_ in rows if i % 50 == 0}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        assert {r.doc_id for r in rows} <= ids, name
        if name != "sentencepiece":
            assert out.columns == docs.columns and all(r.n_chars == len(r.text) for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
        ids = {r.doc_id for r in rows}
    assert all(r.exact for r in rows)


def test_pipeline_keeps_one_of_each_group(spark, docs):
    full = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = [r.doc_id for r in corpus_pipeline.duplicate_stage(spark, full, SF).collect()]
    assert sorted(x for x in kept if x is not None) == [1, 2, 3, 4, 8, 9, 10, 11]


def test_pipeline_links_copies_from_80_percent_on(spark):
    rows = []
    for i in range(20):
        w = [f"{x}{i}" for x in prose(100 + i, 154).split()]  # 150 shingles
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-15], *(f"new{j}" for j in range(15))]))]
    a, b = (shingles(t) for _, t in rows[:2])
    assert 0.80 <= len(a & b) / len(a | b) < 0.85
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r.doc_id for r in corpus_pipeline.duplicate_stage(spark, df, SF).collect()) == list(range(0, 40, 2))
    assert [neardup.matches_of(p) for p in (80, 85, 100)] == [13, 16, 32]


def test_language_levels_come_from_all_texts(spark):
    import numpy as np

    r = random.Random(5)
    rows = [(lang, "".join(r.choice(letters) for _ in range(r.randint(3, 30)))) for lang, letters in (("aa", "abcdefg "), ("bb", "efghijk ")) for _ in range(2600)]
    rows = [(lang, t) for lang, t in rows if t.strip()]
    model, factor, levels = langid.model_of(spark.createDataFrame(rows + rows[:50] + [(None, "abc")], "lang string, text string"))
    distinct = sorted(set(rows))
    values = model.entropies([langid.spelled(t.encode()) for _, t in distinct])
    truth = np.array([model.langs.index(lang) for lang, _ in distinct])
    own = values[np.arange(len(truth)), truth]
    assert np.allclose(levels, [np.quantile(own[truth == i], langid.REJECTED) for i in range(2)], atol=1e-6)
    likely = [(s * own - np.log(np.exp(s * values).sum(axis=1))).sum() for s in 2.0 ** np.arange(-2, 9)]
    assert factor == 2.0 ** (int(np.argmax(likely)) - 2)


def test_language_in_one_pass_as_in_two(spark):
    data = [(i, "aa" if i % 2 else "bb", prose(i, 6 + i % 5) if i % 2 else " ".join(w[::-1] for w in prose(i, 7).split())) for i in range(60)]
    df = spark.createDataFrame(data + [(60, None, "bar"), (61, "aa", None), (None, "aa", "12 !"), (1, *data[1][1:])], "doc_id bigint, lang string, text string")
    learn = df.doc_id % 3 != 1
    learned = langid.model_of(df.where(learn).select("lang", "text"))
    want, got = langid.predict(df, learned).collect(), langid.identified(df, learn).collect()
    key = lambda x: (str(x.doc_id), x.lang_pred, round(x.score, 6), x.accepted)
    assert sorted(map(key, got)) == sorted(map(key, want)) and len(got) == 64


def test_near_duplicates_broadcast_no_table(spark, monkeypatch):
    from vitalens.llm import common, components

    plans = []

    def saved(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.saved(df)

    for module in (neardup, components):
        monkeypatch.setattr(module, "saved", saved)
    out = neardup.near_duplicates(spark.createDataFrame(ROWS, "doc_id bigint, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans)


def test_entries_are_found_together_across_generations():
    from vitalens.llm import bpe

    cache = bpe.Recent(3)
    for k in "abcdefg":
        cache.put(k, k.upper())
    assert cache.known({"d", "e", "f", "g", "z"}) == {"d": "D", "e": "E", "f": "F", "g": "G"}
    assert len(cache) <= 3 and "z" not in cache


def test_forward_pass_tries_no_token_that_cannot_end_there():
    from vitalens.llm import bpe

    forward = bpe.Forward(["a", "b", "c", "ab", "abc", "cabc"], lambda a, b: {"ab": 0, "abc": 1, "cabc": 2}.get(a + b))
    assert forward.reach["abc"] == 4 and "bca" not in forward.reach
    for word in map("".join, itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(1, 7))):
        *_, (_, last, counts) = forward.walk([word])
        tokens, _ = bpe.merge([*word], forward.rank)
        assert counts[-1] == len(tokens) and last[-1] == tokens[-1]
    for a, b, n in [("", "x", 0), ("ab", "abc", 2), ("abd", "abc", 2), ("abc", "ab", 2), ("x", "y", 0)]:
        assert bpe.common_start(a, b) == n


def test_known_words_are_looked_up_by_set_operations(monkeypatch):
    from vitalens.llm import bpe

    model = pieces.Pieces(queries.PIECE_BPE)
    first = [x.tolist() for x in model.encode(["one two three", "two"])]
    monkeypatch.setattr(bpe.Recent, "find", lambda *_: pytest.fail("looked up one by one"))
    assert [x.tolist() for x in model.encode(["one two three", "two"])] == first
