"""Main text of web pages by wrapper induction over same-host pages.

1. Every page is read into a tree of its block elements; siblings of one kind (tag, class, id without digits, and whether
   these, the role or a hidden mark make it chrome) fold into one node, so lists and runs of paragraphs have one shape
   whatever their length.
2. For each host the most frequent tree over all its pages is the reference, and every page is aligned with it by simple
   tree matching (equal roots, children matched in order for the largest common tree).
3. Over all pages of the host, a block of text that (nearly) every page with the node holds is constant: template. It has
   to stand on ``min_pages`` pages that differ from each other, so a page that is there many times makes no template.
   What varies is content, unless it lies in a menu, header, footer, sidebar, notice, advert, form or comment by the
   page's own tags, classes, ids, roles and hidden marks. Where a page has an article or main element, content lies
   inside it; there constant blocks go too, as long as they are at most ``spare`` of the page's text in it, so that a
   host of near copies keeps its text.
4. Nodes without a partner in the reference have no constants, nor have hosts with few pages; the rest holds for them.

Counts are map-side sums by (host, tree) and (host, node, hash of block), so a hot host is no hot task. Wrappers are sent
with the function while all together stay under ``max_wrapper_bytes`` (checked). Beyond it those of the hosts with the most
pages are, as far as they fit, and the others, none of which is a hot host, are joined by host.

Cases: null or empty html, and pages without content, give an empty text; an empty table gives an empty result; broken
markup (unclosed tags, stray ends, cut pages) is read like a browser would, of any depth and length; null url is a host
of its own; repeated rows are extracted alike; extra columns, whatever their names, are not used.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table


@dataclass(frozen=True)
class WrapperConfig:
    #: A constant block stands on so many pages that differ at least (told by 64 residues of their hashes).
    min_pages: int = 5
    #: Share of a node's pages with the same block from which it is template.
    constant: float = 0.9
    #: Inside an article or main element, constant blocks stay where they are more than this share of its text.
    spare: float = 0.3
    max_wrapper_bytes: int = 32_000_000


#: How elements are read.
BLOCKS = frozenset("html head body title div section article main header footer nav aside p ul ol li dl dt dd table caption thead tbody tfoot tr td th form fieldset legend h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address hr details summary dialog menu center label button select option textarea noscript iframe object canvas svg template video audio".split())
RAW = frozenset("script style noscript iframe template textarea svg title object canvas noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("head nav header footer aside form menu dialog button select option textarea label fieldset legend noscript iframe object canvas svg template video audio title".split())
CHROME_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments reply replies respond disqus widget search pagination pager toolbar skip copyright legal".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "thead": ("tr", "td", "th"), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<", re.S)
#: One attribute with its value, so that neither a value nor the end of another name is read as an attribute.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*)))?""")
#: Ends the label of a node that is chrome by class, id, role or a hidden mark.
MARK = "!"


@dataclass(slots=True)
class Node:
    label: str
    tag: str
    chrome: bool
    parent: Node | None = None
    children: dict[str, Node] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether it is chrome by its own tag and attributes)."""
    chrome = tag in CHROME_TAGS
    label = tag
    if attributes:
        names: list[str] = []
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "role":
                chrome |= value.strip() in CHROME_ROLES
            elif name == "hidden":
                chrome |= True
            elif name == "aria-hidden":
                chrome |= value.strip() == "true"
            elif name in ("class", "id"):
                names += [x for x in re.split(r"[^a-z]+", value) if x]
        if names and tag not in ("html", "body", "main", "article") or CHROME_COMMENTS.intersection(names):
            chrome |= not CHROME_WORDS.isdisjoint(names)
        if names:
            label = ".".join([tag, *sorted(set(names))])
    return (label + MARK if chrome and tag not in CHROME_TAGS else label), chrome


CHROME_COMMENTS = frozenset(("comment", "comments", "reply", "replies"))


def read_page(source: str | None) -> tuple[Node, list[tuple[Node, str]]]:
    """The folded tree, and the page's blocks of text in order with their nodes."""
    root = Node("#", "#", False)
    node, tags = root, []
    stack: list[Node] = []
    blocks: list[tuple[Node, str]] = []
    pieces: list[str] = []
    text = source or ""

    def flush() -> None:
        if pieces:
            joined = "".join(pieces)
            pieces.clear()
            if "&" in joined:
                joined = entities.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                node.texts.append(joined)
                blocks.append((node, joined))

    count: dict[str, int] = defaultdict(int)

    def close(at: int) -> None:
        nonlocal node
        flush()
        for t in tags[at:]:
            count[t] -= 1
        del stack[at:]
        del tags[at:]
        node = stack[-1] if stack else root

    def innermost(tag: str, scopes: tuple[str, ...] = ()) -> int:
        """Place of the last open element of that tag, which there is; -1 if one of ``scopes`` lies inside it."""
        place = len(tags) - 1
        while tags[place] != tag:
            if tags[place] in scopes:
                return -1
            place -= 1
        return place

    at, scan = 0, _TOKEN.match
    while at < len(text):
        m = scan(text, at)
        at = m.end()
        token = m[0]
        if token[0] != "<":
            pieces.append(token)
            continue
        tag = m[2] or m[5]
        if tag is None:
            if token == "<":
                pieces.append(token)
            continue
        tag, ending, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if ending:
            if count[tag]:
                close(innermost(tag))
            continue
        if tag in ("br", "hr"):
            pieces.append(" ")
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(text, at)
            at = end.start()
            close_tag = re.compile(r"[^>]*(?:>|\Z)").match(text, at)
            at = close_tag.end()
            continue
        if tag in VOID:
            continue
        block = tag in BLOCKS
        if not block and not attributes and not count[tag]:
            continue
        label, chrome = _kind(tag, attributes)
        if not block and not chrome and not count[tag]:  # inside chrome of its own tag it counts, for the end tags
            continue
        if block:
            flush()
            if count["p"] and tag != "label" and tag != "button":
                close(innermost("p"))
            for closed in CLOSES.get(tag, ()):
                if count[closed]:
                    place = innermost(closed, SCOPES.get(tag, ()))
                    if place >= 0:
                        close(place)
        else:
            flush()
        child = node.children.get(label)
        if child is None:
            child = node.children[label] = Node(label, tag, chrome, node)
        node = child
        stack.append(child)
        tags.append(tag)
        count[tag] += 1
    flush()
    return root, blocks


def _walk(node: Node) -> Iterator[Node]:
    """Nodes in the order of the page, without recursion."""
    work = [node]
    while work:
        node = work.pop()
        yield node
        work += reversed(node.children.values())


def shape(node: Node) -> str:
    out: list[str] = []
    work: list[Node | str] = [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        out.append(x.label)
        if x.children:
            out.append("(")
            work.append(")")
            for i, c in enumerate(reversed(x.children.values())):
                work += [" ", c] if i else [c]
    return "".join(out)


def read_shape(text: str) -> Node:
    root = Node("", "", False)
    stack, last = [root], root
    for m in re.finditer(r"[^() ]+|\(|\)", text):
        if m[0] == "(":
            stack.append(last)
        elif m[0] == ")":
            last = stack.pop()
        else:
            tag = m[0].removesuffix(MARK).partition(".")[0]
            last = Node(m[0], tag, tag in CHROME_TAGS or m[0].endswith(MARK), stack[-1])
            stack[-1].children[m[0]] = last
    return next(iter(root.children.values()))


def _heaviest(ys: list[int], weights: list[int]) -> list[int]:
    """Places of the rising subsequence of ``ys`` with the largest sum of weights; the first such."""
    if all(a < b for a, b in zip(ys, ys[1:])):
        return list(range(len(ys)))
    best: list[tuple[int, int]] = []
    for i, y in enumerate(ys):
        before = max(((best[j][0], -j) for j in range(i) if ys[j] < y), default=(0, 1))
        best.append((before[0] + weights[i], -before[1]))
    at = max(range(len(ys)), key=lambda i: (best[i][0], -i))
    out = []
    while at >= 0:
        out.append(at)
        at = best[at][1]
    return out[::-1]


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: size of the largest common tree from the roots down, and the pairs in it.

    Labels are unique among siblings, so a child has one possible partner and the matching of two rows of children is a
    heaviest rising subsequence. Pairs are met downwards, sizes are summed upwards, without recursion.
    """
    if a.label != b.label:
        return 0, []
    met: list[tuple[Node, Node, list[int]]] = [(a, b, [])]
    rows: list[list[int]] = []  # for each pair, the places among b's children of the partners of a's children
    for x, y, held in met:
        places = {label: i for i, label in enumerate(y.children)}
        rows.append([places[label] for label in x.children if label in places])
        for label, child in x.children.items():
            if label in places:
                held.append(len(met))
                met.append((child, y.children[label], []))
    sizes, chosen = [1] * len(met), [[]] * len(met)
    for i in range(len(met) - 1, -1, -1):
        held = met[i][2]
        chosen[i] = [held[k] for k in _heaviest(rows[i], [sizes[h] for h in held])]
        sizes[i] += sum(sizes[h] for h in chosen[i])
    out, work = [], [0]
    while work:
        i = work.pop()
        out.append(met[i][:2])
        work += chosen[i]
    return sizes[0], out


def roles(root: Node) -> dict[int, tuple[bool, bool]]:
    """For each node, by id: whether its text may be content, and whether it lies inside an article or main element."""
    nodes = list(_walk(root))
    holds: set[int] = set()
    for n in reversed(nodes):  # children come after their parents
        if n.tag in ("article", "main") or id(n) in holds:
            if n.parent is not None:
                holds.add(id(n.parent))
    mains = any(n.tag == "article" and not n.chrome for n in nodes), any(n.tag == "main" for n in nodes)
    out: dict[int, tuple[bool, bool]] = {}
    state: dict[int, tuple[bool, bool]] = {}
    for n in nodes:
        inside, dropped = state[id(n.parent)] if n.parent is not None else (False, False)
        inside = inside or n.tag == "article" or (not mains[0] and n.tag == "main")
        headed = inside and n.tag == "header"
        dropped = dropped or (n.chrome and not headed and not (n.tag not in ("article", "main") and id(n) in holds))
        state[id(n)] = inside, dropped
        keep = not dropped and (inside or not any(mains)) and not headed
        if n.parent is not None and n.parent.tag == "header" and inside:
            keep = keep and n.tag in HEADINGS
        out[id(n)] = keep, inside
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


def _hash(text: str) -> int:
    import xxhash

    return (xxhash.xxh3_64_intdigest(text) - (1 << 63)) or 1


def references(pages: DataFrame) -> DataFrame:
    """host, shape, pages: the most frequent tree of each host and how many pages the host has."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = defaultdict(int)
            for host, source in zip(batch["host"], batch["html"]):
                counts[host, shape(read_page(source)[0])] += 1
            yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["host", "shape", "n"])

    counted = pages.select("host", "html").mapInPandas(shapes, "host string, shape string, n long").groupBy("host", "shape").agg(F.sum("n").alias("n"))
    return counted.groupBy("host").agg(F.max(F.struct("n", "shape")).alias("m"), F.sum("n").alias("pages")).select("host", F.col("m.shape").alias("shape"), "pages")


#: Hosts with more than one in so many pages are hot; there are fewer of them than that.
HOT = 1000


def _with_wrapper(pages: DataFrame, wrappers: DataFrame, columns: list[str], schema: str, body, config: WrapperConfig) -> DataFrame:
    """mapInPandas of ``body(rows, wrapper of host)``; wrappers travel with it, or by a join where they are large."""
    names = [c for c in wrappers.columns if c != "host"]
    bytes_of = sum((F.length(F.col(c).cast("string")) for c in names), F.length("host")).cast("long")
    size, total = wrappers.agg(F.sum(bytes_of), F.sum("pages")).first()
    fits = (size or 0) <= config.max_wrapper_bytes
    known, left = {}, config.max_wrapper_bytes
    sent = wrappers if fits else wrappers.filter(F.col("pages") * HOT > total).orderBy(F.col("pages").desc(), "host")
    for r in sent.withColumn("_bytes", bytes_of).toLocalIterator():
        left -= r["_bytes"]
        if left < 0:
            break
        known[r["host"]] = tuple(r[c] for c in names)
    rows = pages.select("host", *columns)
    if fits:
        return rows.mapInPandas(lambda batches: body(batches, known.get), schema)
    ours = F.col("host").isin(list(known))
    joined = rows.filter(~ours).join(wrappers, "host", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            here = {h: tuple(x) for h, *x in batch[["host", *names]].drop_duplicates("host").itertuples(index=False)}
            yield from body(iter([batch]), here.get)

    return joined.mapInPandas(run, schema).unionByName(rows.filter(ours).mapInPandas(lambda batches: body(batches, known.get), schema))


def induce(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """host, shape, pages and constant: "node:hash of block" of the blocks that hardly vary, comma-joined."""
    refs = shared_table(references(pages), partitions=1)

    def texts(batches: Iterator[pd.DataFrame], wrapper) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[Node, dict[int, int]]] = {}
        for batch in batches:
            counts: dict[tuple[str, int, int], list[int]] = {}
            for host, source in zip(batch["host"], batch["html"]):
                known = wrapper(host)
                if known is None or known[1] < config.min_pages:
                    continue
                if host not in trees:
                    tree = read_shape(known[0])
                    trees[host] = tree, {id(n): i for i, n in enumerate(_walk(tree))}
                tree, numbers = trees[host]
                root, blocks = read_page(source)
                mark = 1 << (_hash("\n".join(t for _, t in blocks)) % 63)
                for own, ref in align(root, tree)[1]:
                    # the node's pages under hash 0, and each of its blocks once a page
                    for h in {0, *map(_hash, own.texts)} if own.texts else ():
                        n = counts.setdefault((host, numbers[id(ref)], h), [0, 0])
                        n[0] += 1
                        n[1] |= mark
            yield pd.DataFrame([(*k, *n) for k, n in counts.items()], columns=["host", "node", "text", "n", "marks"])

    counted = _with_wrapper(pages, refs, ["html"], "host string, node int, text long, n long, marks long", texts, config)
    counted = shared_table(counted.groupBy("host", "node", "text").agg(F.sum("n").alias("n"), F.bit_or("marks").alias("marks")).filter(F.bit_count("marks") >= config.min_pages))
    nodes = counted.filter("text = 0").select("host", "node", F.col("n").alias("all"))
    blocks = counted.filter("text <> 0").join(nodes, ["host", "node"]).filter(F.col("n") >= config.constant * F.col("all"))
    # a page gives a node's constant blocks once each, and nine in ten pages hold them, so they are no more than a page has
    constant = blocks.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("node").cast("string"), F.col("text").cast("string")))), ",").alias("constant"))
    return shared_table(refs.join(constant, "host", "left").select("host", "shape", "pages", F.coalesce("constant", F.lit("")).alias("constant")), partitions=1)


def page_text(source: str | None, tree: Node | None, constant: dict[int, set[int]], config: WrapperConfig = WrapperConfig()) -> str:
    """Blocks that are content by the page's own rules and that are no constants of the reference's node.

    ``constant`` holds the hashes of constant blocks by the id of the reference's node.
    """
    root, blocks = read_page(source)
    own = roles(root)
    kept = [(n, t) for n, t in blocks if own[id(n)][0]]
    if tree is None or not constant:
        return " ".join(t for _, t in kept)
    of = {id(mine): constant[id(ref)] for mine, ref in align(root, tree)[1] if id(ref) in constant}
    fixed = [id(n) in of and _hash(t) in of[id(n)] for n, t in kept]
    inner = [own[id(n)][1] for n, _ in kept]
    size = sum(len(t) for (_, t), i in zip(kept, inner) if i)
    spared = sum(len(t) for (_, t), i, f in zip(kept, inner, fixed) if i and f) > config.spare * size
    return " ".join(t for (_, t), i, f in zip(kept, inner, fixed) if not f or (i and spared))


def extract(pages: DataFrame, config: WrapperConfig = WrapperConfig()) -> DataFrame:
    """page_id, url, text of every row."""
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers = induce(rows, config)

    def texts(batches: Iterator[pd.DataFrame], wrapper) -> Iterator[pd.DataFrame]:
        trees: dict[str, tuple[Node | None, dict[int, set[int]]]] = {}
        for batch in batches:
            out = []
            for page, url, host, source in zip(batch["page_id"], batch["url"], batch["host"], batch["html"]):
                known = wrapper(host)
                if known is not None and host not in trees:
                    tree, constant = None, defaultdict(set)
                    if known[2]:
                        tree = read_shape(known[0])
                        ids = [id(n) for n in _walk(tree)]
                        for x in known[2].split(","):
                            node, _, block = x.partition(":")
                            constant[ids[int(node)]].add(int(block))
                    trees[host] = tree, constant
                out.append((page, url, page_text(source, *trees.get(host, (None, {})), config)))
            yield pd.DataFrame(out, columns=["page_id", "url", "text"]).astype({"page_id": "Int64"})

    return _with_wrapper(rows, wrappers, ["page_id", "url", "html"], "page_id long, url string, text string", texts, config)
