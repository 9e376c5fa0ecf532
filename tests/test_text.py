import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from vitalens.functions import text as tx
from vitalens.functions.core import round1
from vitalens.sources import ingest, sinks


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"t {kind}")
    return df.select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "raw,want",
    [
        ("\u2022 \ufb01le one\r\n\n\n\n\u25cf two", "\u2022 file one\n\u2022 two"),
        ("a\n\n\n\nb  \n c\t!", "a\n\nb\n c    !"),
        ("\u2022\nnext", "\u2022 next"),
        ("\u2022\n\u25aax", "\u2022 \u2022 x"),
        ("head\n\n   \u25cf item \u25cf inner", "head\n\u2022 item \u2022 inner"),
        ("\u201cq\u201d \u2013 caf\u0065\u0301", "\"q\" - caf\u00e9"),
        ("x\u200by\x07z\u2028w", "xyz\u2028w"),
        ("", ""),
        (" \n\n \t", ""),
        ("one", "one"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, tx.clean) == want


@pytest.mark.parametrize(
    "text,n",
    [("\u00e9tude na\u00efve x", 3), ("it's well-known -- a", 3), ("'' -- \u2022", 0), ("a_b c3", 2), ("", 0)],
)
def test_word_count(spark, text, n):
    assert one(spark, text, tx.word_count) == n


def test_page_estimate_rounds_half_to_even(spark):
    rows = [one(spark, n, tx.page_estimate, "int") for n in (0, 250, 750, 1250, 1300)]
    assert rows == [1, 1, 2, 2, 3]


def test_strip_is_unicode_and_linear(spark):
    assert one(spark, "\u3000 a b \u2028", tx.ustrip) == "a b"
    assert one(spark, "x" + " " * 200_000 + "y", tx.ustrip).endswith("y")
    assert len(one(spark, "x" + "\n" * 200_000 + "\u2022 y", tx.clean)) == 5


def test_text_that_skips_python_is_already_normal():
    pattern = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m.group(1), 16)), tx.NFKC_UNSTABLE)
    for code in range(1, 0x2500):
        ch = chr(code)
        if ch in tx.NFKC_STABLE_PUNCTUATION or not re.match(pattern, ch):
            assert unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch)


def test_round1_follows_the_binary_value(spark):
    for x in (1.05, 3.25, 2.35, 2.45, 0.15, 0.05, 99.95, -1.25, -1.05, 0.0, 100.0, 3.75, 0.35):
        assert one(spark, x, round1, "double") == round(x, 1)


def test_decoding_fallback(spark):
    long = "plain words " * 20
    rows = [
        ("a.txt", long.encode()),
        ("b.txt", long.encode("utf-16")),
        ("c.txt", (long + "\u0416\u00e9").encode("utf-16-le")),
        ("d.txt", (long + "\u00e9").encode("latin-1")),
        ("e.txt", b"\xfe\xff" + long.encode("utf-16-be")),
    ]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn(
        "codec", ingest.codec(F.col("content"))
    )
    got = {
        r.path: (r.codec, r.t.strip())
        for r in df.select("path", "codec", ingest.decode(F.col("content"), F.col("codec")).alias("t")).collect()
    }
    assert {p: c for p, (c, _) in got.items()} == {
        "a.txt": "utf-8", "b.txt": "utf-16le", "c.txt": "utf-16le", "d.txt": "latin-1", "e.txt": "utf-16be",
    }
    assert all(t.startswith("plain words") for _, t in got.values())


def test_ingest_splits_files(spark, tmp_path):
    good = "A line of readable text.\n" * 10
    for name, data in {
        "a.txt": good.encode(), "b.doc": b"x" * 500, "c.txt": b"", "d.txt": b"too short",
        "e.png": b"x" * 200, "f.pdf": b"x" * 200, "g.md": good.encode(), "noext": b"x" * 200,
        "big.txt": b"x" * (5 * 1024 * 1024 + 1),
    }.items():
        (tmp_path / name).write_bytes(data)
    accepted, rejected = ingest.ingest(ingest.read_files(spark, str(tmp_path)))
    ok = {r.filename: r for r in accepted.collect()}
    assert set(ok) == {"a.txt", "g.md"}
    assert ok["a.txt"].layout.word_count == 50 and len(ok["a.txt"].text_hash) == 64
    why = {r.path.rsplit("/", 1)[-1]: r.reject_reason for r in rejected.collect()}
    assert why == {
        # Spark's file source never yields the empty c.txt.
        "b.doc": "legacy_format", "d.txt": "almost_no_text",
        "e.png": "unsupported_type", "f.pdf": "needs_text_extraction", "noext": "unsupported_type",
        "big.txt": "too_large",
    }


def _uploads(folder):
    good = "A line of readable text.\n" * 10
    for name, data in {"a.txt": good.encode(), "b.doc": b"x" * 500, "d.txt": b"too short", "u.md": good.encode("utf-16")}.items():
        (folder / name).write_bytes(data)
    with open(folder / "huge.txt", "wb") as f:
        f.truncate(3 << 30)  # sparse; Spark's file source cannot read files beyond 2 GiB at all
    return {"accepted": 2, "legacy_format": 1, "almost_no_text": 1, "too_large": 1}


def test_uploads_are_stored_in_one_pass_and_oversize_files_stay_closed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    want = _uploads(tmp_path / "in")
    marked = ingest.mark(ingest.read_files(spark, str(tmp_path / "in")))
    for _ in range(2):  # a repeat replaces its run
        counts = sinks.write_uploads(marked, str(tmp_path / "out"), "r1")
    assert {k: n for k, n in counts.items() if n} == want
    stored = sinks.read_uploads(spark, str(tmp_path / "out"), "r1")
    docs = ingest.accepted_of(stored.filter("accepted")).collect()
    assert sorted((r.filename, r.codec) for r in docs) == [("a.txt", "utf-8"), ("u.md", "utf-16le")]
    assert {r.text for r in docs} == {("A line of readable text.\n" * 10).strip()}
    assert {r.path.rsplit("/", 1)[-1]: r.reject_reason for r in ingest.rejected_of(stored).collect()} == {
        "b.doc": "legacy_format", "d.txt": "almost_no_text", "huge.txt": "too_large",
    }


def test_ingest_reads_contents_in_one_scan(spark, tmp_path):
    _uploads(tmp_path)
    plan = ingest.mark(ingest.read_files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line or "BinaryFile" in line]
    with_content = [line for line in scans if "content" in line.split("Batched")[0]]
    assert len(scans) == 2 and len(with_content) == 1
    assert "LessThanOrEqual(length,5242880)" in with_content[0]
    assert plan.count("sha2(") <= 3 and "Exchange" not in plan


def test_word_counts_equal_the_matches_of_a_plain_pattern(spark):
    import re

    texts = ["", " ", "one", "one two", "-- a-b' 'c --d-- ", "x", "x x", "é ñandú _ 12\n\n't", "a\U0001F600b -", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("text", tx.word_count(F.col("text")).alias("n")).collect()
    for r in rows:
        assert r.n == (None if r.text is None else len(re.findall(r"\w[\w'-]*", r.text)))


def test_strip_takes_every_space_in_any_order(spark):
    texts = ["", " ", "a", "a ", "a  ", "a  ", "a  ", "a \n   　  ", "  a b \t", "　", "​ ", "é  ", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for r in rows.select("text", tx.ustrip(F.col("text")).alias("both"), tx.rstrip(F.col("text")).alias("right")).collect():
        assert (r.both, r.right) == ((None, None) if r.text is None else (r.text.strip(tx.SPACES), r.text.rstrip(tx.SPACES)))
    # Only another space than U+0020 at the end asks for the slow trim.
    assert "endswith" in str(tx.rstrip(F.col("text"))).lower()
