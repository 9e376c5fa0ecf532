"""Main text of web pages by wrapper induction.

Pages of one host share a template.  A wrapper is folded from the trees of all of its
pages: a page is laid over the wrapper by simple tree matching, which pairs the most
nodes top-down while keeping the order of siblings; paired nodes merge, the others are
inserted.  Then every page is laid over the whole wrapper, and pages are counted by node
and text.  Text that stands in the same node on nearly all pages is constant and part of
the template; everything else is a slot.  To extract, a page is laid over the wrapper
again, and its text is what stands in slots of the content: the articles (or main parts),
without navigation, headers and footers, asides, notices, adverts, forms, comments, scripts
and styles, which elements and their class, id and role names tell.

Siblings of one kind in a row are one run and pair as a whole, so a page of ten thousand
paragraphs costs no more than its length.

Pages are read once; their trees are saved.  The wrapper is folded from their skeletons
(trees without texts, each different one once) in groups of at most FOLDED, whose wrappers
are folded in turn, so that no group grows with the host.  A node whose path of elements
stands on fewer than MIN_PAGES pages can hold nothing constant and is left out, which keeps
class names made for one page out of the wrapper.  A page of the same article as another
counts once.  Wrappers travel by a join on the host, so a host of many pages is split by
adaptive joins.

Null and empty pages give an empty text.  Pages without host share the empty host.
Markup that is cut off or not closed is read as far as it goes.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalens.llm.common import arrow_map, saved, slices

FOLDED, MIN_PAGES, CONSTANT = 500, 4, 0.8

BLOCKS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th "
    "caption figure figcaption details summary address hr header footer nav aside form fieldset center".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head script style noscript template svg math iframe object nav aside footer form button select textarea dialog canvas audio video menu".split())
#: Words in class, id or role that tell what is not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side widget nav navbar navigation menu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup share sharing "
    "social related recommended comment comments commentlist disqus replies reply respond pagination pager toolbar search login contentinfo complementary alert".split()
)
CONTENT = frozenset("content post entry article story".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|noscript|iframe|svg)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I,
)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


class Node:
    __slots__ = ("tag", "sign", "kids", "dropped", "content")

    def __init__(self, tag: str, names: tuple[str, ...] = ()):
        words = {w for n in names for w in re.split(r"[^a-z]+", n)}
        self.tag, self.sign, self.kids = tag, (tag, *names), []
        self.dropped = tag in DROPPED or tag not in ("html", "body", "article", "main") and not words.isdisjoint(NAMES) or tag == "article" and bool(words & {"comment", "comments", "reply"})
        self.content = 0 if self.dropped else 3 if tag == "article" else 2 if tag == "main" or "main" in names else 1 if words & CONTENT else 0


def parsed(page: str) -> Node:
    """The tree of a page; kids are nodes and strings."""
    root = Node("html")
    stack = [root]

    def leave(tags) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return
            if stack[i].tag in ("table", "ul", "ol", "dl", "article", "main", "body"):
                return

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            stack[-1].kids.append(text)
            continue
        tag = (m["tag"] or "").lower()
        if not tag or tag == "html":
            continue
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag == "br" or tag == "wbr":
            stack[-1].kids.append(" " if tag == "br" else "")
            continue
        if tag in ENDS_P:
            leave({"p"})
        if tag in CLOSES:
            leave(CLOSES[tag])
        if tag == "body":
            del stack[1:]
        elif tag in ("article", "main"):  # the article never lies in a menu that was not closed
            cut = next((i for i, n in enumerate(stack) if n.tag in DROPPED and n.tag != "aside"), None)
            if cut:
                del stack[cut:]
        rest = m["rest"]
        node = Node(tag, tuple(" ".join(next(filter(None, g), "").lower().split()) for g in NAMED.findall(rest)) if "=" in rest else ())
        stack[-1].kids.append(node)
        if tag not in VOID and not rest.endswith("/"):
            stack.append(node)
    return root


def blocks(node: Node) -> list[tuple[str, Node | None]]:
    """The kids of a block in order: texts of its own, inline markup dissolved, and inner blocks."""
    out: list[tuple[str, Node | None]] = []
    loose: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(loose)).split())
        loose.clear()
        if text:
            out.append((text, None))

    def walk(at: Node) -> None:
        for kid in at.kids:
            if isinstance(kid, str):
                loose.append(kid)
            elif kid.dropped:
                if kid.tag in BLOCKS or kid.tag in DROPPED:
                    flush()
            elif kid.tag in BLOCKS or any(not isinstance(k, str) and k.tag in BLOCKS for k in kid.kids):
                flush()
                out.append(("", kid))
            else:
                walk(kid)

    walk(node)
    flush()
    return out


def outermost(root: Node, wanted) -> list[Node]:
    """In page order, the nodes that are wanted and lie in no other such node."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if wanted(node):
            out.append(node)
        else:
            todo += [k for k in reversed(node.kids) if not isinstance(k, str) and not k.dropped]
    return out


def content(root: Node) -> list[Node]:
    """The parts of a page that are its article: all elements of the best kind that holds most of
    the text in content elements; if no kind does, all content elements, else the body."""
    every = outermost(root, lambda n: n.content)
    most = sum(map(length, every))
    for kind in (3, 2, 1):
        found = outermost(root, lambda n: n.content == kind)
        if found and 2 * sum(map(length, found)) > most:
            return found
    return every or [root]


def length(node: Node) -> int:
    return sum(len(k.strip()) if isinstance(k, str) else length(k) for k in node.kids if isinstance(k, str) or not k.dropped)


# A tree is (sign, items): its texts (strings) and runs of like blocks (sign, trees), in page order.


def shape(node: Node) -> tuple:
    items: list = []
    for text, kid in blocks(node):
        if kid is None:
            items.append(text)
        elif items and not isinstance(items[-1], str) and items[-1][0] == kid.sign:
            items[-1][1].append(shape(kid))
        else:
            items.append((kid.sign, [shape(kid)]))
    return node.sign, items


def content_shape(page: str) -> tuple:
    """A tree without sign that holds the content elements of a page."""
    items: list = []
    for node in content(parsed(page)):
        if items and items[-1][0] == node.sign:
            items[-1][1].append(shape(node))
        else:
            items.append((node.sign, [shape(node)]))
    return "", items


def texts_of(items: list) -> list[str]:
    return [x for x in items if isinstance(x, str)]


def runs_of(items: list) -> list[tuple]:
    return [x for x in items if not isinstance(x, str)]


def packed(tree) -> bytes:
    """A tree as bytes, the same for equal trees."""
    return zlib.compress(json.dumps(tree, separators=(",", ":")).encode(), 1)


def unpacked(data: bytes):
    return json.loads(zlib.decompress(data))


def hashed(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def skeleton(tree) -> tuple:
    """A tree without texts; members of a run that look alike stand once."""
    items = []
    for sign, trees in runs_of(tree[1]):
        members = []
        for kid in map(skeleton, trees):
            if kid not in members:
                members.append(kid)
        items.append((sign, members))
    return tree[0], items


def paths(tree, above: int = 0) -> set[int]:
    """The hashed paths of elements at which a tree has nodes."""
    out = set()
    for sign, trees in runs_of(tree[1]):
        here = hashed(f"{above} {json.dumps(sign)}")
        out.add(here)
        for kid in trees:
            out |= paths(kid, here)
    return out


def pruned(tree, kept: set[int], above: int = 0) -> tuple:
    """A skeleton without the nodes whose paths are not kept."""
    items = []
    for sign, trees in runs_of(tree[1]):
        here = hashed(f"{above} {json.dumps(sign)}")
        if here in kept:
            items.append((sign, [pruned(kid, kept, here) for kid in trees]))
    return skeleton((tree[0], items))


class Wrapper:
    """A template node.  Once all pages are folded, nodes are numbered and know their constant texts."""

    __slots__ = ("sign", "runs", "number", "fixed")

    def __init__(self, sign):
        self.sign, self.runs, self.number, self.fixed = sign, [], 0, ()

    def fold(self, trees: list) -> None:
        """Merge the nodes of a run into this node."""
        for _, items in trees:
            at, runs = 0, runs_of(items)
            for w, r in aligned(self.runs, runs):
                if w is None:
                    self.runs.insert(at, Wrapper(runs[r][0]))
                    w = at
                if r is not None:
                    self.runs[w].fold(runs[r][1])
                at = w + 1

    def tree(self) -> tuple:
        return self.sign, [(w.sign, [w.tree()]) for w in self.runs]

    def nodes(self) -> list[Wrapper]:
        return [self] + [n for w in self.runs for n in w.nodes()]


def folded(skeletons: list) -> Wrapper:
    """The wrapper of some skeletons, or of wrappers' trees."""
    wrapper = Wrapper("")
    wrapper.fold(skeletons)
    for number, node in enumerate(wrapper.nodes()):
        node.number = number
    return wrapper


def with_constants(wrapper: Wrapper, constants: list[tuple[int, int]]) -> Wrapper:
    """The wrapper, with hashes of constant texts by the numbers of its nodes."""
    nodes, fixed = wrapper.nodes(), {}
    for number, text in constants:
        fixed.setdefault(number, set()).add(text)
    for number, texts in fixed.items():
        nodes[number].fixed = texts
    return wrapper


def matching(wrapper_runs: list, runs: list) -> list[list[int]]:
    """Simple tree matching of two lists of siblings: the most pairs of any two heads of them."""
    table = [[0] * (len(runs) + 1) for _ in range(len(wrapper_runs) + 1)]
    for i, w in enumerate(wrapper_runs, 1):
        for j, (sign, trees) in enumerate(runs, 1):
            pair = 0
            if w.sign == sign:
                inner = runs_of(trees[0][1])
                pair = 1 + (matching(w.runs, inner)[-1][-1] if w.runs and inner else 0)
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + pair if pair else 0)
    return table


def aligned(wrapper_runs: list, runs: list, inserting: bool = True):
    """Pairs (wrapper place, page place) in order; None where one side has no partner.

    If inserting, wrapper places count what the caller inserts for earlier pairs without partner."""
    table = matching(wrapper_runs, runs)
    i, j, out = len(wrapper_runs), len(runs), []
    while i or j:
        if i and j and wrapper_runs[i - 1].sign == runs[j - 1][0] and table[i][j] > max(table[i - 1][j], table[i][j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif j and (not i or table[i][j - 1] >= table[i - 1][j]):
            j -= 1
            out.append((None, j))
        else:
            i -= 1
            out.append((i, None))
    shift = 0
    for w, r in reversed(out):
        if w is None:
            yield None, r
            shift += inserting
        else:
            yield w + shift, r


def partners(runs: list, node: Wrapper | None) -> dict[int, Wrapper]:
    """The wrapper node on which each run of a page lies, by the run's place."""
    if not node or not node.runs or not runs:
        return {}
    return {r: node.runs[w] for w, r in aligned(node.runs, runs, False) if w is not None and r is not None}


def placed(tree, node: Wrapper, out: set) -> set[tuple[int, int | None]]:
    """Each node of the wrapper on which a part of the page lies, alone and with each text in it."""
    runs = runs_of(tree[1])
    out.add((node.number, None))
    out.update((node.number, hashed(t)) for t in texts_of(tree[1]))
    for place, on in partners(runs, node).items():
        for kid in runs[place][1]:
            placed(kid, on, out)
    return out


def extracted(tree, node: Wrapper | None) -> list[str]:
    """The texts of a block that stand in slots, in page order."""
    out, place = [], 0
    on = partners(runs_of(tree[1]), node)
    for item in tree[1]:
        if isinstance(item, str):
            if not node or not node.fixed or hashed(item) not in node.fixed:
                out.append(item)
        else:
            for kid in item[1]:
                out += extracted(kid, on.get(place))
            place += 1
    return out


def main_text(page: str, node: Wrapper | None) -> str:
    return "\n\n".join(extracted(content_shape(page), node))


class Unfolded(dict):
    """Wrappers by their bytes and constants, remembered up to a bound."""

    def __missing__(self, key):
        data, constants = key
        if len(self) > 1000:
            self.clear()
        found = self[key] = with_constants(folded([unpacked(data)]), constants) if data else None
        return found


def read_trees(pages: DataFrame) -> DataFrame:
    """page_id, url, host; the hash of all texts, the skeleton and the tree of a page (null for none)."""

    def read(batches):
        for batch in slices(batches):
            columns = [[], [], []]
            for page in batch.column(3).to_pylist():
                tree = None if page is None else content_shape(page)
                found = (None, None, None) if tree is None else (hashed("\n\n".join(extracted(tree, None))), packed(skeleton(tree)), packed(tree))
                for column, value in zip(columns, found):
                    column.append(value)
            article, bones, tree = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary())))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], article, bones, tree], names=["page_id", "url", "host", "article", "skeleton", "tree"])

    return arrow_map(pages.select("page_id", "url", "host", "html"), read, "page_id bigint, url string, host string, article bigint, skeleton binary, tree binary")


def wrappers_of(trees: DataFrame) -> DataFrame:
    """host, wrapper: one wrapper for all pages of a host."""
    bones = trees.where("skeleton is not null").groupBy("host", "skeleton").agg(F.count_distinct("article").alias("n"))
    bones = saved(bones.withColumn("id", F.xxhash64("skeleton")))

    def list_paths(batches):
        for batch in slices(batches):
            found = [sorted(paths(unpacked(b))) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))], names=["host", "id", "n", "paths"])

    on = arrow_map(bones.select("host", "id", "n", "skeleton"), list_paths, "host string, id bigint, n bigint, paths array<bigint>")
    on = on.select("host", "id", "n", F.explode("paths").alias("path"))
    often = on.groupBy("host", "path").agg(F.sum("n").alias("pages")).where(F.col("pages") >= MIN_PAGES).drop("pages")
    kept = on.join(often, ["host", "path"]).groupBy("host", "id").agg(F.collect_set("path").alias("kept"))

    def prune(batches):
        for batch in slices(batches):
            cut = [packed(pruned(unpacked(b), set(k or ()))) for b, k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.binary())], names=["host", "wrapper"])

    def fold(group):
        import pandas as pd

        wrapper = folded([unpacked(b) for b in sorted(group["wrapper"])])
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [packed(wrapper.tree())]})

    joined = bones.join(kept, ["host", "id"], "left").select("host", "skeleton", "kept")
    now = saved(arrow_map(joined, prune, "host string, wrapper binary").distinct())
    while True:
        sizes = now.groupBy("host").agg(F.count("*").alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        groups = F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") / FOLDED)) if most > FOLDED else F.lit(0)
        now = saved(now.join(sizes, "host").withColumn("part", groups).groupBy("host", "part").applyInPandas(lambda g: fold(g), "host string, wrapper binary"))
        if most <= FOLDED:
            return now


def constants_of(trees: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, constants: the texts that stand in a node on nearly all pages that have the node."""

    def place(batches):
        known = Unfolded()
        for batch in slices(batches):
            host, article, node, text = [], [], [], []
            for h, a, tree, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                for number, t in placed(unpacked(tree), known[wrapper, ()], set()):
                    host.append(h), article.append(a), node.append(number), text.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(article, pa.int64()), pa.array(node, pa.int32()), pa.array(text, pa.int64())], names=["host", "article", "node", "constant"])

    rows = arrow_map(trees.where("tree is not null").join(wrappers, "host").select("host", "article", "tree", "wrapper"), place, "host string, article bigint, node int, constant bigint")
    counts = saved(rows.groupBy("host", "node", "constant").agg(F.count_distinct("article").alias("n")).where(F.col("n") >= MIN_PAGES * CONSTANT))
    pages = counts.where("constant is null").where(F.col("n") >= MIN_PAGES).select("host", "node", F.col("n").alias("pages"))
    found = counts.where("constant is not null").join(pages, ["host", "node"]).where(F.col("n") >= CONSTANT * F.col("pages"))
    return found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("node", "constant"))).alias("constants"))


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    pages = df.select(df[id_col].cast("bigint").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html")).withColumn("host", host)
    trees = saved(read_trees(pages))
    wrappers = wrappers_of(trees)
    known = saved(wrappers.join(constants_of(trees, wrappers), "host"))
    joined = trees.join(known, "host", "left")

    def extract(batches):
        known = Unfolded()
        for batch in slices(batches):
            out = []
            for tree, wrapper, constants in zip(*(c.to_pylist() for c in batch.columns[2:])):
                on = known[wrapper, tuple((c["node"], c["constant"]) for c in constants or ())]
                out.append("" if tree is None else "\n\n".join(extracted(unpacked(tree), on)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    return arrow_map(joined.select("page_id", "url", "tree", "wrapper", "constants"), extract, "page_id bigint, url string, text string")
