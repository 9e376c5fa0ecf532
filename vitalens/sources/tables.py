"""The given tables, and the views the operators are bound to on them.

Every view is one SQL text used by Spark and by the DuckDB oracle alike; the
``Dialect`` only covers spelling (integer division, ordered string aggregation,
global regex replacement).
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from vitalens.session import spread

TODAY = date(2002, 1, 1)  # the given orders end in 2001


@dataclass(frozen=True)
class Dialect:
    idiv: str
    agg: str
    rx: str
    rx_find: str

    def render(self, sql: str) -> str:
        out = sql
        for name in ("agg", "rx", "rx_find"):
            mark = f"@{name}("
            while mark in out:
                start = out.index(mark)
                depth, i, args, last = 1, start + len(mark), [], start + len(mark)
                while depth:
                    ch = out[i]
                    if ch == "(":
                        depth += 1
                    elif ch == ")":
                        depth -= 1
                    if (ch == "," and depth == 1) or depth == 0:
                        args.append(out[last:i].strip())
                        last = i + 1
                    i += 1
                out = out[:start] + getattr(self, name).format(*args) + out[i:]
        return out.replace("@div", self.idiv)


SPARK = Dialect(
    idiv="div",
    agg="listagg({0}, {1}) WITHIN GROUP (ORDER BY {2})",
    rx="regexp_replace({0}, {1}, {2})",
    rx_find="regexp_extract({0}, {1}, {2})",
)
DUCKDB = Dialect(
    idiv="//",
    agg="string_agg({0}, {1} ORDER BY {2})",
    rx="regexp_replace({0}, {1}, {2}, 'g')",
    rx_find="regexp_extract({0}, {1}, {2})",
)

# Career documents: one per customer, built from its orders, their items and a whole document.
# Branches are chosen by modulus so that every rule fires for some documents only.
CV_DOCS = r"""
WITH keyed AS (
  SELECT c_custkey, c_nationkey, c_custkey % (SELECT count(*) FROM documents) AS doc_key FROM customer),
ranked_orders AS (
  SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS role_no
  FROM orders),
roles AS (
  SELECT o_custkey AS k, o_orderkey, o_orderstatus, role_no,
         CAST(extract(year FROM o_orderdate) AS INT) AS y,
         CAST(extract(month FROM o_orderdate) AS INT) AS m,
         CAST(extract(year FROM o_orderdate) * 12 + extract(month FROM o_orderdate) - 1
              + o_orderkey % 30 AS INT) AS end_ord
  FROM ranked_orders),
ranked_items AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS item_no
  FROM lineitem),
items AS (
  SELECT r.k, r.o_orderkey, i.item_no, i.l_partkey,
    (CASE WHEN r.k % 3 = 0 THEN '- ' WHEN r.k % 3 = 1 THEN '• ' ELSE '* ' END)
    || split_part('Led,Built,Responsible for,Improved,Worked on,Designed,Helped with,Reduced,Managing,Analysed,The team kept,Automated', ',',
         CAST(1 + (CASE WHEN r.k % 5 = 2 AND i.l_partkey % 12 IN (2, 4, 6) THEN 1
                        WHEN r.k % 14 = 3 THEN 0 ELSE i.l_partkey % 12 END) AS INT))
    || CASE WHEN i.l_partkey % 17 = 3 OR r.k % 43 = 4 THEN ' tasks' ELSE
         split_part(', the billing platform, the customer reports, a data pipeline, the search service, a mobile app, the hiring plan, the sales dashboard', ',', CAST(2 + i.l_suppkey % 7 AS INT))
         || CASE WHEN i.l_returnflag = 'R' AND r.k % 4 < 3 THEN ' by ' || CAST(i.l_partkey % 90 + 5 AS STRING) || '%'
                 WHEN i.l_returnflag = 'A' AND r.k % 2 = 0 THEN ' for 3 teams'
                 WHEN i.l_partkey % 19 = 5 THEN ' worth $4k'
                 WHEN i.l_partkey % 19 = 6 THEN ' running 2x faster since 1999' ELSE '' END
         || CASE i.l_partkey % 23 WHEN 0 THEN ' as needed' WHEN 1 THEN ' as a team player'
                 WHEN 2 THEN ' with a proven track record' WHEN 3 THEN ' and more'
                 WHEN 4 THEN ' and I trained my team' ELSE '' END
         || CASE WHEN r.k % 11 = 5 AND item_no <= 2 THEN ' across several regional offices and partner organisations while keeping every existing commitment to clients and suppliers and preparing the handover of all supporting documents to the operations group before the end of the planning season without delay or rework' ELSE '' END
       END AS bullet
  FROM ranked_items i JOIN roles r ON i.l_orderkey = r.o_orderkey),
role_bullets AS (
  SELECT o_orderkey, @agg(bullet, chr(10), item_no) AS bullets FROM items GROUP BY o_orderkey),
role_text AS (
  SELECT r.k, r.role_no,
    split_part('Senior Engineer,Data Analyst,Product Manager,Team Lead,Consultant', ',', CAST(1 + r.o_orderkey % 5 AS INT))
    || ', ' || split_part('Northlake Systems,Tallpine Foods,Brightwell Labs,Redgate Freight', ',', CAST(1 + r.o_orderkey % 4 AS INT))
    || ' | '
    || CASE WHEN r.k % 47 = 5 THEN 'remote' ELSE
       CASE WHEN r.k % 6 = 0 THEN '' WHEN r.k % 6 = 1 THEN CAST(r.m AS STRING) || '/'
            ELSE split_part('Jan,Feb,March,Apr.,May,June,Jul,Aug,Sept,Oct,November,Dec', ',', r.m) || ' ' END
    || CAST(r.y AS STRING)
    || CASE WHEN r.o_orderkey % 4 = 1 THEN ' to ' ELSE ' - ' END
    || CASE WHEN r.o_orderstatus = 'O' AND r.role_no >= 2
            THEN CASE WHEN r.k % 8 = 3 THEN 'current' ELSE 'Present' END
            ELSE CASE WHEN r.k % 6 = 0 THEN '' WHEN r.k % 6 = 1 THEN CAST(r.end_ord % 12 + 1 AS STRING) || '/'
                      ELSE split_part('Jan,Feb,March,Apr.,May,June,Jul,Aug,Sept,Oct,November,Dec', ',', CAST(r.end_ord % 12 + 1 AS INT)) || ' ' END
                 || CAST(r.end_ord @div 12 AS STRING) END END
    || CASE WHEN b.bullets IS NULL OR r.k % 37 = 9 THEN '' ELSE chr(10) || b.bullets END AS role_block
  FROM roles r LEFT JOIN role_bullets b ON r.o_orderkey = b.o_orderkey),
work AS (
  SELECT k, @agg(role_block, chr(10), role_no) AS work_text FROM role_text GROUP BY k),
parts AS (
  SELECT c.c_custkey AS k, c.c_nationkey AS nk,
    CASE WHEN c.c_custkey % 15 = 4 THEN chr(10) ELSE chr(10) || chr(10) END AS sep,
    c.c_custkey % 3 AS style, w.work_text,
    split_part('Dana,Amir,Lucia,Tomas,Ingrid,Wei,Nora,Pavel,Zoe,Omar,Freya', ',', CAST(1 + c.c_custkey % 11 AS INT)) AS fn,
    split_part('Whitfield,Santos,Okafor,Lindqvist,Moreau,Tanaka,Kowalski', ',', CAST(1 + c.c_custkey % 7 AS INT)) AS ln,
    @rx(d.text, '[^A-Za-z]+', ' ') AS blurb
  FROM keyed c
  LEFT JOIN documents d ON d.doc_id = c.doc_key
  LEFT JOIN work w ON w.k = c.c_custkey),
blocks AS (
  SELECT k, nk, sep, style,
    CASE WHEN k % 13 = 0 THEN lower(fn || ' ' || ln) ELSE fn || ' ' || ln END
    || chr(10) || concat_ws(' | ',
      CASE WHEN k % 10 <> 3 THEN split_part('Austin; TX,Berlin; Germany,Lyon; France,Porto; Portugal,Leeds; UK,Osaka; Japan', ',', 1 + nk % 6) END,
      CASE WHEN k % 5 = 0 THEN NULL
           WHEN k % 25 = 1 THEN 'crazy' || CAST(k AS STRING) || '@mail.example.org'
           WHEN k % 25 = 2 THEN lower(fn) || CAST(k AS STRING) || '@hotmail.com'
           ELSE lower(fn) || '.' || lower(ln) || '@example.com' END,
      CASE WHEN k % 17 = 0 THEN 'alt' || CAST(k AS STRING) || '@example.net' END,
      CASE WHEN k % 3 = 1 THEN '+1 415 555 ' || lpad(CAST(k % 10000 AS STRING), 4, '0')
           WHEN k % 3 = 2 THEN '(020) 7946 ' || lpad(CAST(k % 10000 AS STRING), 4, '0') END,
      CASE WHEN k % 2 = 0 THEN 'linkedin.com/in/' || lower(fn) || CAST(k AS STRING) END,
      CASE WHEN k % 6 = 1 THEN 'https://github.com/' || lower(fn) END,
      CASE WHEN k % 14 = 5 THEN 'www.' || lower(ln) || '.example.com/work' END)
    || CASE WHEN k % 29 = 0 THEN chr(10) || 'Date of birth: 4 May 1980 | Nationality: French' ELSE '' END
    || CASE WHEN k % 41 = 2 THEN chr(10) || 'Photograph attached' ELSE '' END AS head,
    CASE WHEN k % 19 = 1 THEN NULL ELSE
      split_part('Professional Summary,Summary,Profile,About Me,Career Objective', ',', CAST(1 + k % 5 AS INT)) END AS summary_h,
    blurb
    || CASE WHEN k % 9 = 0 THEN ' with a proven' || chr(10) || 'track record' ELSE '' END
    || CASE WHEN k % 8 = 3 THEN ' and I know that my work helps us' ELSE '' END
    || CASE WHEN k % 4 = 1 THEN chr(10) || blurb WHEN k % 28 = 6 THEN repeat(chr(10) || blurb, 5) ELSE '' END
    || CASE WHEN k % 27 = 4 THEN repeat('★', 13) ELSE '' END
    || CASE WHEN k % 33 = 6 THEN repeat(chr(10) || repeat('several regional offices and partner organisations kept every commitment ', 2), 5) ELSE '' END
    || CASE WHEN k % 34 = 8 THEN repeat(chr(10) || 'our GLOBAL SALES TEAM grew', 5) ELSE '' END AS summary_b,
    CASE WHEN k % 19 = 0 THEN NULL ELSE
      split_part('Experience,Work Experience,Employment History,Professional Experience & Projects', ',', CAST(1 + k % 4 AS INT)) END AS work_h,
    CASE WHEN k % 23 = 0 THEN '' ELSE coalesce(chr(10) || work_text, '') END AS work_b,
    CASE WHEN k % 19 = 2 THEN NULL ELSE split_part('Education,Academic Background', ',', CAST(1 + k % 2 AS INT)) END AS edu_h,
    CASE WHEN k % 23 = 1 THEN '' WHEN k % 47 = 5 THEN chr(10) || 'BSc Computing, City University' ELSE chr(10) || 'BSc Computing, City University, 1990 - 1994' END AS edu_b,
    CASE WHEN k % 19 = 3 THEN NULL ELSE split_part('Skills,Technical Skills,Core Competencies,Tech Stack', ',', CAST(1 + k % 4 AS INT)) END AS skills_h,
    CASE WHEN k % 23 = 2 THEN '' ELSE chr(10) || 'Python, SQL, Kafka, ' || split_part('Docker,React,Terraform,Excel,Spark', ',', CAST(1 + k % 5 AS INT))
    || CASE WHEN k % 31 = 0 THEN ', Microsoft Word, Email' ELSE '' END
    || CASE WHEN k % 38 = 0 THEN chr(10) || repeat('alpha beta ', 65) || 'gamma' ELSE '' END END AS skills_b,
    concat_ws(chr(10),
      CASE WHEN k % 16 = 7 THEN 'Hobbies' || chr(10) || 'Chess and cycling' END,
      CASE WHEN k % 12 = 5 THEN 'References' || chr(10) || 'Available on request' END,
      CASE WHEN k % 8 = 2 THEN 'Side Projects' || chr(10) || '- Built a chess engine serving 40 users' || chr(10) || '- Wrote a parser' END,
      CASE WHEN k % 21 = 0 THEN 'filler line' || chr(10) || 'MY JOURNEY' || chr(10) || 'From field work to software' END,
      CASE WHEN k % 24 = 3 THEN 'filler line' || chr(10) || 'GREEN BLOCK' || chr(10) || 'one' || chr(10) || 'BLUE BLOCK' || chr(10) || 'two' || chr(10) || 'RED BLOCK' || chr(10) || 'three' END) AS extra
  FROM parts),
titled AS (
  SELECT k, sep, nk,
    replace(head, ';', ',') AS head,
    (CASE style WHEN 0 THEN upper(summary_h) WHEN 1 THEN summary_h ELSE summary_h || ':' END) || chr(10) || summary_b AS s_block,
    (CASE style WHEN 0 THEN upper(work_h) WHEN 1 THEN work_h ELSE work_h || ':' END) || work_b AS w_block,
    (CASE style WHEN 0 THEN upper(edu_h) WHEN 1 THEN edu_h ELSE edu_h || ':' END) || edu_b AS e_block,
    (CASE style WHEN 0 THEN upper(skills_h) WHEN 1 THEN skills_h ELSE skills_h || ':' END) || skills_b AS k_block,
    nullif(extra, '') AS extra
  FROM blocks)
SELECT k AS doc_id, CAST(k % 97 AS STRING) AS owner_id, 'cv-' || CAST(k AS STRING) || '.txt' AS filename,
  CASE WHEN k % 7 = 0 THEN concat_ws(sep, head, s_block, e_block, w_block, k_block, extra)
       WHEN k % 35 = 9 THEN concat_ws(sep, head, w_block, e_block, s_block, k_block, extra)
       ELSE concat_ws(sep, head, s_block, w_block, e_block, k_block, extra) END AS text,
  CASE WHEN k % 20 = 9 THEN 5 WHEN k % 20 = 8 THEN 3 END AS page_count,
  CASE WHEN k % 24 = 1 THEN 1 ELSE 0 END AS table_count,
  CASE WHEN k % 26 = 0 THEN 3 WHEN k % 26 = 1 THEN 1 ELSE 0 END AS image_count,
  CASE WHEN k % 18 = 0 THEN 1 ELSE 0 END AS multi_column_pages,
  k % 28 = 0 AS has_header_footer_text,
  k % 39 = 0 AS is_scanned
FROM titled
"""

# The same for Spark: a document's letters are taken once per document and not once per customer, apart from
# the long last step, which the JVM only interprets; texts are joined last, so that no other step moves them.
_BLURB = "@rx(d.text, '[^A-Za-z]+', ' ')"
_TEXT_JOIN, _WORK_JOIN = "LEFT JOIN documents d ON d.doc_id = c.doc_key", "LEFT JOIN work w ON w.k = c.c_custkey"
SPARK_CV_DOCS = CV_DOCS.replace(_BLURB, "d.text").replace(f"{_TEXT_JOIN}\n  {_WORK_JOIN}", f"{_WORK_JOIN}\n  {_TEXT_JOIN}")

# Stored reviews: one per event.
EV_REVIEWS = r"""
SELECT event_id AS review_id,
       CAST(user_id AS STRING) || '-' || CAST(CAST(@rx_find(props, '([0-9]+)', 1) AS INT) % 3 AS STRING) AS doc_id,
       CAST(user_id AS STRING) AS owner_id,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
       least(value, 100.0) AS overall,
       CASE WHEN event_type = 'purchase' THEN 'text' END AS ai_review,
       CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'analyst' END AS target_role,
       ts AS created_at
FROM events
"""

EV_DOCS = r"""
SELECT CAST(user_id AS STRING) || '-' || CAST(CAST(@rx_find(props, '([0-9]+)', 1) AS INT) % 3 AS STRING) AS doc_id,
       min(CAST(user_id AS STRING)) AS owner_id,
       'upload-' || CAST(min(event_id) AS STRING) || '.txt' AS filename,
       min(ts) AS created_at
FROM events
GROUP BY 1
"""

# Daily reviews per user with findings: rule and severity from type and k.
EV_FINDINGS = r"""
WITH tagged AS (
  SELECT CAST(user_id AS STRING) || '@' || substr(CAST(ts AS STRING), 1, 10) AS review_id,
         CAST(user_id AS STRING) AS owner_id, event_type, event_id, ts,
         CAST(@rx_find(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
distinct_rules AS (
  SELECT review_id, owner_id, event_type, k % 5 AS code, min(event_id) AS first_event
  FROM tagged GROUP BY review_id, owner_id, event_type, k % 5)
SELECT review_id, owner_id,
  CASE event_type WHEN 'click' THEN 'contact' WHEN 'view' THEN 'structure' WHEN 'error' THEN 'ats'
       WHEN 'purchase' THEN 'impact' ELSE 'formatting' END AS category,
  event_type || '.' || CAST(code AS STRING) AS rule_id,
  CASE code WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'suggestion'
       WHEN 3 THEN 'positive' ELSE 'warning' END AS severity,
  CASE code WHEN 0 THEN 22.0 WHEN 1 THEN 15.5 WHEN 2 THEN 5.0 WHEN 3 THEN 0.0 ELSE 7.0 END AS penalty,
  CASE WHEN first_event % 4 = 0 THEN NULL
       ELSE CASE event_type WHEN 'click' THEN 'header' WHEN 'view' THEN 'skills' WHEN 'error' THEN 'summary'
                 WHEN 'purchase' THEN 'experience' ELSE 'education' END END AS section
FROM distinct_rules
"""

# The rule ids that occur in them.
EV_RULES = tuple(f"{t}.{code}" for t in ("click", "error", "purchase", "signup", "view") for code in range(5))

EV_DAYS = r"""
SELECT CAST(user_id AS STRING) || '@' || substr(CAST(ts AS STRING), 1, 10) AS review_id,
       CAST(user_id AS STRING) AS doc_id,
       CAST(user_id AS STRING) AS owner_id,
       CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'complete' END AS status,
       max(least(value, 100.0)) AS overall,
       max(ts) AS created_at
FROM events
GROUP BY 1, 2, 3
"""

# Documents with typographic glyphs, bullets, tabs and blank runs mixed in.
DIRTY_DOCS = r"""
SELECT doc_id, replace(replace(replace(replace(replace(text,
    ' the ', chr(10) || chr(10) || '  ●  the '),
    ' de ', ' – ﬁde​ '),
    ' und ', chr(9) || 'und   ' || chr(10) || chr(10) || chr(10)),
    ' of ', ' ’of“ ▪ '),
    ' el ', chr(13) || chr(10) || '▪' || chr(10) || '· el ★★★') AS text
FROM documents
"""

# Files an uploader might send, described without their bytes.
FILES = r"""
SELECT 'in/doc-' || CAST(doc_id AS STRING)
         || split_part('.txt,.MD,.pdf,.docx,.doc,.png,,.txt', ',', CAST(1 + doc_id % 8 AS INT)) AS path,
       CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 5242881 ELSE n_chars END AS length
FROM documents
"""

POSTINGS = "SELECT item_id AS posting_id, text FROM benchmark"

# Requirement lists in posting form, over the vocabulary the career documents use.
CV_POSTINGS = r"""
SELECT p_partkey AS posting_id,
  'Requirements:' || chr(10)
  || '• Experience with ' || split_part('Python,Kubernetes,JavaScript,PostgreSQL,Kafka,Terraform,Scrum', ',', CAST(1 + p_partkey % 7 AS INT))
  || ', ' || split_part('SQL,Docker,React,Spark,Excel', ',', CAST(1 + p_partkey % 5 AS INT)) || ' and mentoring engineers' || chr(10)
  || '- ' || p_name || ' pricing, billing platform' || chr(10)
  || 'You will build data pipelines; ' || p_brand || ' dashboards. Reporting to the sales team' AS text
FROM part
"""

OWNERS = r"""
SELECT CAST(c_custkey AS STRING) AS owner_id,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS target_role,
       c_acctbal > 0 AS is_active
FROM customer
"""

# Word boxes of pages, and table cells, from order items.
WORD_BOXES = r"""
SELECT l_suppkey AS doc_id, l_linenumber AS page,
       CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 560
            WHEN l_partkey % 25 = 0 THEN 290
            WHEN l_partkey % 2 = 0 THEN 40 + l_partkey % 180
            ELSE 345 + l_partkey % 200 END AS DOUBLE) AS x0,
       CAST(CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 560
            WHEN l_partkey % 25 = 0 THEN 290
            WHEN l_partkey % 2 = 0 THEN 40 + l_partkey % 180
            ELSE 345 + l_partkey % 200 END + 8 + l_partkey % 40 AS DOUBLE) AS x1,
       CAST(612 AS DOUBLE) AS page_width
FROM lineitem
"""

CELLS = r"""
SELECT l_orderkey AS doc_id, l_linenumber AS table_no, rn AS row_no, col_no,
  CASE col_no WHEN 0 THEN l_returnflag WHEN 1 THEN CASE WHEN l_partkey % 3 = 0 THEN l_returnflag ELSE l_linestatus END
       WHEN 2 THEN CASE WHEN l_partkey % 5 = 0 THEN '' ELSE l_linestatus END ELSE l_linestatus END AS cell
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus,
             row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn
      FROM lineitem) x
CROSS JOIN (SELECT 0 AS col_no UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) cols
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, names: list[str], **prepared: DataFrame) -> DataFrame:
    """Run a view's SQL on the given tables, some of which may stand prepared."""
    text = SPARK.render(sql)
    for n in [*names, *prepared]:
        text = _qualify(text, n)
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names}, **prepared)


def _qualify(text: str, name: str) -> str:
    import re

    return re.sub(rf"\b(FROM|JOIN)\s+{name}\b", rf"\1 {{{name}}}", text)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def dirty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, DIRTY_DOCS, ["documents"]), "doc_id")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FILES, ["documents"])


def cv_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Career documents with a ``layout`` struct."""
    from pyspark.sql import functions as F

    letters = F.regexp_replace("text", "[^A-Za-z]+", " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", letters.alias("text"))
    flat = view(spark, sf_dir, SPARK_CV_DOCS, ["orders", "lineitem", "customer"], documents=docs)
    names = [
        "page_count", "table_count", "image_count", "multi_column_pages",
        "has_header_footer_text", "is_scanned",
    ]
    return flat.select("doc_id", "owner_id", "filename", "text", F.struct(*names).alias("layout"))


def ev_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EV_REVIEWS, ["events"])


def ev_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EV_DOCS, ["events"])


def ev_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EV_FINDINGS, ["events"])


def ev_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EV_DAYS, ["events"])


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTINGS, ["benchmark"])


def cv_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, CV_POSTINGS, ["part"]), "posting_id")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, OWNERS, ["customer"])


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, WORD_BOXES, ["lineitem"])


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CELLS, ["lineitem"])
