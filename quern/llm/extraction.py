"""Main text of web pages by a site style tree.

The documents of a host are merged into one tree. Its nodes are paths of
elements with their ids and classes; a node of text keeps what pages say there,
a node of elements which children it has had, in which order (its presentations).
Entropy over the host's pages tells templates from articles:

- a node of text matters by 1 less the mean entropy of its texts over the pages
  that have it: what all pages say alike has entropy 1;
- a node of elements matters by the entropy of its presentations and, the less
  of those it has, by what the texts below it do on the average.

A branch goes from every page of the host where it and all nodes in it matter
less than a threshold. Copies of a page count once, and a page keeps what it has
where all would go.

Entropy alone can't do it: menus, adverts and footers whose words change from
page to page matter as much as articles to it, and a host's only page says
nothing. What an author has marked by an element's name, role, id or class
therefore counts first: marked branches of the kinds listed below are left out,
and where a page marks its article the article's paragraphs are never judged.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.store import staged
from quern.llm.urls import host_of

#: Importance below which a branch is a template's, and the pages of different texts that it takes to say so.
THRESHOLD, LEAST_PAGES = 0.3, 3
#: How a node's own presentations count against what is below it: 1 - DECAY ** presentations.
DECAY = 0.9
#: Elements of a path that have nodes of their own; what is deeper belongs to the last.
DEEPEST = 32
#: Nodes that are sent to all tasks at most.
FEW = 100_000
#: A list is a menu outside a marked article if it has so many links and they have this share of its text.
LINKS, LINKED = 3, 0.8

#: Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption address summary".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary ul".split())
SCOPE = frozenset("table td th caption button object template html".split())
BOUNDS = {"li": frozenset("ul ol menu dir".split()), "dd": frozenset(("dl",)), "dt": frozenset(("dl",)), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "tr": frozenset("tbody thead tfoot table".split()), "tbody": frozenset(("table",)), "thead": frozenset(("table",)), "tfoot": frozenset(("table",))}
ALIKE = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}

#: Elements, roles and words of ids and classes that name what isn't the article.
OTHER_TAGS = frozenset("nav footer aside form dialog menu search template svg math object canvas audio video select button datalist fieldset head".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus
    footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promos promotion recommended
    related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar topbar widget widgets""".split()
)
#: Of those the ones that an article element itself may bear: then it isn't the page's.
OTHER_ARTICLES = frozenset("ad ads advert comment comments promo recommended related replies reply sponsored teaser teasers widget".split())
#: Words before others in a class that say what a page has, not what an element is.
ABOUT_PAGES = frozenset("has no with without is hide show js".split())
MAIN_TAGS, MAIN_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
MAIN_WORDS, MAIN_BESIDE = frozenset("article content entry main post story".split()), frozenset("body text page single area".split())

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?>(?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+))(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Numbers of pages in ids and classes, and all numbers in texts, count as one.
_PAGE_NUMBER, _NUMBER = re.compile("[0-9]{3,}"), re.compile("[0-9]+")

#: Zones: left out, of a form, unmarked, marked by a class, marked by an element or role.
OTHER, FORM, PLAIN, WEAK, STRONG = -2, -1, 0, 1, 2


def _words(name: str) -> list[str]:
    """The words of an id or a class in lower case; none if it says what a page has."""
    words = [w.lower() for w in _WORDS.findall(name)]
    return [] if words and words[0] in ABOUT_PAGES else words


def _marks(name: str) -> tuple[bool, bool]:
    """Whether an id or a class names something else, and whether it names the article."""
    words = _words(name)
    return not OTHER_WORDS.isdisjoint(words), not MAIN_WORDS.isdisjoint(words) and set(words) <= MAIN_WORDS | MAIN_BESIDE


@lru_cache(maxsize=1 << 14)
def described(tag: str, attributes: str) -> tuple[str, int | None, bool]:
    """An element's label, the zone that it asks for (None: its parent's) and whether it has an id or a class."""
    if not attributes.strip(" /\n\t\r\f"):
        zone = STRONG if tag in MAIN_TAGS else FORM if tag == "form" else OTHER if tag in OTHER_TAGS else None
        return tag, zone, False
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    names = [*found.get("id", "").split(), *sorted(set(found.get("class", "").split()))]
    label = " ".join([tag, *(_PAGE_NUMBER.sub("#", n) for n in names)])
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    if hidden or role in OTHER_ROLES:
        return label, OTHER, bool(names)
    if tag in MAIN_TAGS or role in MAIN_ROLES or "articlebody" in found.get("itemprop", "").lower():
        words = {w for n in names for w in _words(n)}
        return label, OTHER if tag == "article" and not OTHER_ARTICLES.isdisjoint(words) else STRONG, bool(names)
    if tag == "form" or tag in OTHER_TAGS:
        return label, FORM if tag == "form" else OTHER, bool(names)
    other, main = (any(x) for x in zip(*map(_marks, names))) if names and tag not in ("html", "body") else (False, False)
    return label, None if other == main else OTHER if other else WEAK, bool(names)


def _below(parent: int, tag: str, asked: int | None) -> int:
    """The zone of an element with that of its parent and what it asks for."""
    if parent == OTHER or asked == OTHER:
        return OTHER
    if tag == "header":  # an article's header holds its title
        return parent if parent >= WEAK else OTHER
    if asked == FORM:
        return FORM
    if parent == FORM:  # some pages are one form
        return STRONG if asked == STRONG else FORM
    return parent if asked is None else max(parent, asked)


class Element:
    __slots__ = ("tag", "zone", "node", "chain", "style", "links", "linked", "length", "list")

    def __init__(self, tag, zone, node, chain, of):
        self.tag, self.zone, self.node, self.chain, self.style = tag, zone, node, chain, 0
        # Figures of the list or container that the element belongs to.
        self.list = self if tag not in TEXTUAL or of is None else of
        self.links = self.linked = self.length = 0


def _number(*parts) -> int:
    return xxhash.xxh64_intdigest(repr(parts).encode()) - 2**63


def blocks_of(page: str) -> tuple[list[tuple[int, str, int, tuple[int, ...]]], list[tuple[int, int]]]:
    """(zone, text, node, branches) of a page's blocks of text that may be its article's, and (node, presentation) of its elements.

    Branches are the nodes that may go, from the outermost on: containers, and
    elements with an id or a class, within the page or its marked article.
    """
    root = Element("html", PLAIN, _number("html"), (), None)
    stack, found, styles = [root], [], []
    text: list[str] = []
    open_tags: dict[str, int] = {}
    linked, in_link, at, end = 0, False, 0, len(page)

    def flush():
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                top = stack[-1]
                found.append((top.zone, whole, top.node, top.chain, top.list))
                top.list.length += len(whole)
                top.list.linked += min(linked, len(whole))
            text.clear()
        linked = 0

    def pop():
        gone = stack.pop()
        open_tags[gone.tag] -= 1
        if gone.zone >= PLAIN and gone.chain and gone.chain[-1] == gone.node:
            styles.append((gone.node, gone.style))

    def close(names, stop):
        """Ends the nearest open element of the names, and those in it, unless one that stops the search comes first."""
        if not any(open_tags.get(name) for name in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in stop:
                return

    while at < end:
        m = _TAG.search(page, at)
        piece = page[at : m.start() if m else end]
        top = stack[-1]
        if piece and top.zone >= PLAIN:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:  # a comment or a declaration
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = False
            if tag in INLINE and top.zone >= PLAIN:
                continue
            flush()
            if tag not in ("html", "body", "br"):
                close((tag,), SCOPE - {tag} if tag in CLOSES_P or tag in ALIKE else ())
            continue
        if tag in RAW:
            close_at = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            at = close_at.start() if close_at else end
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag in INLINE and top.zone >= PLAIN:
            if tag == "a":
                in_link = True
                top.list.links += 1
            label, asked, _ = described(tag, m[3])
            if asked != OTHER or top.zone >= WEAK:
                continue
        elif tag not in CLOSES_P and tag not in TEXTUAL and tag not in OTHER_TAGS and tag not in BOUNDS and tag not in ("table", "html", "body", "center", "fieldset", "legend", "colgroup", "optgroup", "option", "frameset") and top.zone >= PLAIN:
            continue  # unknown elements don't break a line
        flush()
        if tag in CLOSES_P:
            close(("p",), SCOPE)
            if tag[0] == "h" and tag[1:].isdigit() and stack[-1].tag[0] == "h" and stack[-1].tag[1:].isdigit():
                pop()
        elif tag in BOUNDS:
            close(ALIKE[tag], BOUNDS[tag])
        if tag in ("html", "body"):
            continue
        top = stack[-1]
        label, asked, named = described(tag, m[3])
        zone = _below(top.zone, tag, asked)
        deep = len(stack) > DEEPEST
        node = top.node if deep else _number(top.node, label, zone)
        top.style = _number(top.style, label)
        starts = zone == STRONG and top.zone != STRONG
        branch = zone >= PLAIN and not deep and not starts and (named or tag not in TEXTUAL)
        chain = () if starts else (*top.chain, node) if branch else top.chain
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(Element(tag, zone, node, chain, top.list if zone == top.zone else None))
    flush()
    while len(stack) > 1:
        pop()
    best = max((b[0] for b in found), default=PLAIN)
    menu = lambda e: best < STRONG and e.links >= LINKS and e.linked >= LINKED * e.length
    kept = [b[:4] for b in found if b[0] == best and not menu(b[4])]
    return kept, styles


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A row per page: page_id, url, host, texts and nodes (its blocks, one beside the other), and what the host's tree is made of:

    digest (of the texts), said (node, text, times and first: one of a node's
    texts has 1), chains (node and its branches) and styles (node, style, first).
    """
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    shape = "texts array<string>, nodes array<long>, digest long, said array<struct<node:long,text:long,times:int,first:int>>, chains array<struct<node:long,chain:array<long>>>, styles array<struct<node:long,style:long,first:int>>"
    long, few = pa.int64(), pa.int32()
    kinds = [
        pa.list_(pa.string()), pa.list_(long), long, pa.list_(pa.struct([("node", long), ("text", long), ("times", few), ("first", few)])),
        pa.list_(pa.struct([("node", long), ("chain", pa.list_(long))])), pa.list_(pa.struct([("node", long), ("style", long), ("first", few)])),
    ]
    names = ["texts", "nodes", "digest", "said", "chains", "styles"]

    def one(page: str):
        blocks, styles = blocks_of(page)
        times: dict[tuple[int, int], int] = {}
        for _, text, node, _ in blocks:
            key = node, xxhash.xxh64_intdigest(_NUMBER.sub("#", text).encode("utf-8", "surrogatepass")) - 2**63
            times[key] = times.get(key, 0) + 1
        seen: set[int] = set()
        fresh = lambda node: 0 if node in seen else seen.add(node) or 1
        said = [{"node": n, "text": t, "times": k, "first": fresh(n)} for (n, t), k in times.items()]
        seen.clear()
        chains = {node: chain for _, _, node, chain in blocks}
        texts = [b[1] for b in blocks]
        return texts, [b[2] for b in blocks], _number(*texts), said, [{"node": n, "chain": list(c)} for n, c in chains.items()], [{"node": n, "style": s, "first": fresh(n)} for n, s in styles]

    def run(batches):
        for batch in batches:
            made = list(zip(*(one(x.as_py()) for x in batch.column(2)))) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(made, kinds))], ["page_id", "url", *names])

    whole = kept.select("page_id", "url", *(F.lit(None).cast(c.split(" ", 1)[1]).alias(c.split(" ", 1)[0]) for c in re.split(r", (?=[a-z]+ (?:array|long))", shape)))
    out = kept.mapInArrow(run, whole.schema)
    return out.withColumn("host", host_of(F.col("url").cast("string")))


def style_tree(pages: DataFrame) -> DataFrame:
    """The nodes of all hosts' trees, of ``parsed`` pages: host, node, kind (text or elements), pages, importance, chain (of text nodes).

    Pages of the same texts on a host count once. A page without a host is of no
    tree.
    """
    once = pages.where("host <> ''").groupBy("host", "digest").agg(F.min(F.struct("said", "chains", "styles")).alias("p")).select("host", "p.*")
    once = staged(once, "once")
    each = once.select("host", F.explode("said").alias("s")).select("host", "s.*")
    # A text's entropy over pages is ln T - (sum of t ln t) / T, for t occurrences on a page and T in all.
    texts = each.groupBy("host", "node", "text").agg(F.sum("times").alias("t"), F.sum(F.col("times") * F.log(F.col("times"))).alias("s"), F.sum("first").alias("pages"))
    spread = F.avg(F.log("t") - F.col("s") / F.col("t"))
    leaves = texts.groupBy("host", "node").agg(F.sum("pages").alias("pages"), spread.alias("h"))
    chains = once.select("host", F.explode("chains").alias("c")).groupBy("host", "c.node").agg(F.min("c.chain").alias("chain"))
    share = lambda h, n: F.when(n > 1, F.least(h / F.log(n), F.lit(1.0))).otherwise(1.0)
    imp = F.when(F.col("pages") > 1, 1 - share(F.col("h"), F.col("pages"))).otherwise(1.0)
    leaves = staged(leaves.join(chains, ["host", "node"]).select("host", "node", "pages", imp.alias("importance"), "chain"), "leaves")
    shown = once.select("host", F.explode("styles").alias("s")).select("host", "s.*").groupBy("host", "node", "style").agg(F.count("*").alias("c"), F.sum("first").alias("pages"))
    shown = shown.groupBy("host", "node").agg(F.sum("pages").alias("pages"), F.sum("c").alias("n"), F.count("*").alias("k"), F.sum(F.col("c") * F.log("c")).alias("s"))
    below = leaves.select("host", F.explode("chain").alias("node"), "importance", "pages")
    below = below.groupBy("host", "node").agg((F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("below"))
    varied = share(F.log("n") - F.col("s") / F.col("n"), F.col("n"))
    own = 1 - F.pow(F.lit(DECAY), F.col("k"))
    # An element without text below it has nothing to lose.
    inner = shown.join(below, ["host", "node"]).select("host", "node", "pages", (own * varied + (1 - own) * F.col("below")).alias("importance"))
    none = F.lit(None).cast("array<long>")
    return leaves.select("host", "node", F.lit("text").alias("kind"), "pages", "importance", "chain").unionByName(inner.select("host", "node", F.lit("elements").alias("kind"), "pages", "importance", none.alias("chain")))


def unimportant(tree: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and node of the text nodes in a branch that, with all nodes in it, is of less importance than ``threshold`` on ``least_pages`` or more."""
    tree = staged(tree, "tree")
    texts, inner = tree.where("kind = 'text'"), tree.where("kind = 'elements'")
    # A branch's nodes: its texts, and the branches at and after its place in their chains.
    held = texts.select("host", "importance", F.posexplode("chain").alias("i", "branch"), "chain", "node")
    most = held.select("host", "branch", "importance").unionByName(
        held.select("host", "branch", F.explode(F.slice("chain", F.col("i") + 1, F.size("chain"))).alias("node")).distinct().join(inner.select("host", "node", "importance"), ["host", "node"]).select("host", "branch", "importance")
    )
    low = most.groupBy("host", "branch").agg(F.max("importance").alias("most")).where(F.col("most") < threshold)
    # A text with an id or a class is a branch by itself.
    pages = tree.select("host", F.col("node").alias("branch"), "pages")
    low = low.join(pages, ["host", "branch"]).where(F.col("pages") >= least_pages).select("host", "branch").distinct()
    return held.select("host", "branch", "node").join(low, ["host", "branch"], "left_semi").select("host", "node").distinct()


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """A row per page: page_id, url, text and n_chars.

    A null or empty page has an empty text, and so has one without an article. A
    page without a host is judged by its marks alone. Ids and URLs may be null
    and repeated and rows are kept as they come; a very long page is read whole
    in one task, in time in proportion to its length; an empty table gives no
    rows; other columns are left out, whatever their names.
    """
    rows = staged(parsed(pages, id_col, url_col, html_col).withColumn("row", F.monotonically_increasing_id()), "parsed")
    low = staged(unimportant(style_tree(rows), threshold, least_pages), "low")
    n = low.count()
    if n <= FEW:
        gone = F.broadcast(low.groupBy(F.col("host").alias("of")).agg(F.collect_set("node").alias("gone")))
        met = rows.join(gone, F.col("host") == F.col("of"), "left")
    else:
        each = rows.select("row", "host", F.explode(F.array_distinct("nodes")).alias("node"))
        gone = each.join(low, ["host", "node"]).groupBy(F.col("row").alias("of")).agg(F.collect_set("node").alias("gone"))
        met = rows.join(gone, F.col("row") == F.col("of"), "left")
    stays = F.filter(F.arrays_zip("texts", "nodes"), lambda b: F.coalesce(~F.array_contains("gone", b["nodes"]), F.lit(True)))
    met = met.withColumn("stays", F.transform(stays, lambda b: b["texts"]))
    text = F.array_join(F.when(F.size("stays") > 0, F.col("stays")).otherwise(F.col("texts")), " ")
    return met.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op12_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
