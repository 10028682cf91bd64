"""HTML extraction with site template removal: element subtrees are hashed, counted per host in Spark, and those that
recur across many different pages of their host are deleted, wherever they are in a page. The main text is then the block
that holds most of what is left, without elements that are by their kind not part of it."""

from __future__ import annotations

import html as _html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, table

# Names of elements and of classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
DROPPED = frozenset("nav footer aside form script style noscript iframe svg canvas button select textarea input head title template object menu dialog label fieldset datalist audio video math".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr header hgroup center".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "dt", "dd", "li"}
FENCES = frozenset("table td th ul ol dl div section article main body html blockquote".split())
NOISE = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-?nav|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|comments?|commentlist|respond|replies|disqus|related|recommended|footer|masthead|site-?header|page-?header|pagination|pager|widget|toolbar|skip-?link)(?:$|[-_\s])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<![^>]*>|<\?[^>]*>|([^<]+)|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: A subtree is the site's if it is on at least so many different pages of the host, and on this share of them or, on large
#: hosts, on MANY_PAGES. Within an article or main element only a larger share counts, as passages recur there.
MIN_PAGES, SHARE, MANY_PAGES, ARTICLE_SHARE = 8, 0.2, 100, 0.6
#: Articles, or main elements, are the main block if they hold this share of what the page has left.
MAIN_SHARE = 0.5
#: Up to so many such subtrees of all hosts are sent to every task (8 bytes each); beyond, they are joined to the pages.
BROADCAST_TEMPLATES = 200_000


class Node:
    __slots__ = ("tag", "attributes", "children", "begin", "end", "hash", "own")

    def __init__(self, tag: str, attributes: str, begin: int):
        self.tag, self.attributes, self.begin, self.end = tag, attributes, begin, begin
        self.children: list = []
        self.hash = self.own = 0


def parse(source: str) -> Node:
    """The tree of a page: nodes, and strings for text. Open elements are closed where HTML closes them by itself; end tags
    without a start, comments and declarations are left out; nothing is too broken to be read."""
    root = Node("", "", 0)
    stack, at, n = [root], 0, len(source)
    while at < n:
        m = TOKEN.match(source, at)
        at = m.end()
        if m.group(4) is not None:
            stack[-1].children.append(m.group(4))
        elif m.group(2) is None:
            if m.group() == "<":
                stack[-1].children.append("<")
        elif tag := m.group(2).lower():
            if m.group(1):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        for node in stack[i:]:
                            node.end = m.start()
                        stack[i].end = at
                        del stack[i:]
                        break
                    if stack[i].tag in FENCES and tag not in FENCES and tag not in DROPPED:
                        break
                continue
            closes = CLOSES.get(tag) or ({"p"} if tag in ENDS_P else None)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        for node in stack[i:]:
                            node.end = m.start()
                        del stack[i:]
                        if tag != "tr":
                            break
                    elif stack[i].tag in FENCES:
                        break
            node = Node(tag, m.group(3), m.start())
            stack[-1].children.append(node)
            if tag in VOID or m.group(3).endswith("/") and tag in ("svg", "path"):
                node.end = at
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                node.children.append(source[at : close.start() if close else n])
                at = node.end = close.end() if close else n
            else:
                stack.append(node)
    for node in stack:
        node.end = n
    return root


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): _html.unescape(a or b or c or "") for k, a, b, c in ATTRIBUTE.findall(node.attributes)} if node.attributes.strip() else {}


def is_noise(node: Node, in_article: bool) -> bool:
    """Whether an element is by its kind not part of the main text."""
    if node.tag in DROPPED or node.tag == "header" and not in_article:
        return True
    if not node.attributes or node.tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node)
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    return any(NOISE.search(a[k]) for k in ("class", "id") if a.get(k))


def _ordered(root: Node) -> list[tuple[Node, bool]]:
    """All elements, each before its children, and whether it lies in an article or main element."""
    out = [(root, False)]
    for node, inside in out:  # grows as it is read
        inside = inside or node.tag in ("article", "main")
        out += [(c, inside) for c in node.children if not isinstance(c, str)]
    return out


def hash_subtrees(nodes: list[tuple[Node, bool]]) -> None:
    """Give every element the hash of its tag, attributes, texts without surplus white space and children's hashes: each
    text is read once, however deep it lies."""
    import xxhash

    for node, _ in reversed(nodes):
        x = xxhash.xxh64(f"{node.tag}\x00{' '.join(node.attributes.split())}")
        for c in node.children:
            if not isinstance(c, str):
                x.update(c.hash.to_bytes(8, "little", signed=True))
            elif words := " ".join(c.split()):
                x.update(f"\x01{words}")
        node.hash = x.intdigest() - (1 << 63)


def _counted(node: Node) -> bool:
    """Whether a subtree may be a template: a block with something in it that is not the page or its main element."""
    return node.tag not in ("", "html", "body", "head", "article", "main") and (node.tag in BLOCKS or node.tag in DROPPED) and bool(node.children)


def subtrees(source: str) -> list[tuple[int, bool]]:
    """(hash, whether it lies in an article) of every block element with something in it."""
    nodes = _ordered(parse(source))
    hash_subtrees(nodes)
    return list(dict.fromkeys((node.hash, inside) for node, inside in nodes if _counted(node)))


def prune(root: Node, templates) -> None:
    """Take out subtrees whose (hash, in article) is in templates and elements that are by their kind noise, and count the
    letters and digits that each element has left (own)."""
    nodes = _ordered(root)
    if templates:
        hash_subtrees(nodes)
    for node, inside in nodes:
        within = inside or node.tag in ("article", "main")
        kept = []
        for c in node.children:
            if not isinstance(c, str) and (is_noise(c, within) or templates and _counted(c) and (c.hash, within) in templates):
                c.children = []
                if c.tag in BLOCKS:
                    kept.append(Node("hr", "", 0))  # a block ends where one is taken out
            else:
                kept.append(c)
        node.children = kept
    for node, _ in reversed(_ordered(root)):
        node.own = sum(c.own if not isinstance(c, str) else sum(map(str.isalnum, c)) for c in node.children)


def main_blocks(root: Node) -> list[Node]:
    """The articles of a pruned page, or its main elements, if they hold most of what is left; else the page itself, so that a
    teaser beside the text is not taken for it."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or 'role="main"' in n.attributes):
        found = _outermost(root, wanted)
        if found and sum(n.own for n in found) >= MAIN_SHARE * root.own:
            return found
    return [root]


def main_text(source: str | None, templates=frozenset()) -> str:
    """The page's text without noise and without subtrees whose (hash, in article) is in templates. Blocks are joined by two
    line ends; white space within one is a single blank."""
    if not source:
        return ""
    root = parse(source)
    prune(root, templates)
    blocks: list[str] = []
    now: list[str] = []

    def flush():
        text = re.sub(r"\s+", " ", "".join(now)).strip()
        now.clear()
        if text:
            blocks.append(text)

    for top in main_blocks(root):
        todo: list = [top]  # nodes or texts to visit, or None where a block ends
        while todo:
            node = todo.pop()
            if node is None:
                flush()
                continue
            if isinstance(node, str):
                now.append(_html.unescape(node))
                continue
            if node.tag == "br":
                now.append(" ")
            if node.tag in BLOCKS:
                flush()
                todo.append(None)
            todo += reversed(node.children)
        flush()
    return "\n\n".join(blocks)


def _outermost(root: Node, wanted) -> list[Node]:
    found, open_ = [], [root]
    while open_:
        node = open_.pop()
        if node.tag and wanted(node):
            found.append(node)
        else:
            open_ += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def host(url):
    """The host of a URL in lower case; an empty string without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """pages(url, html) to (host, page, hash, inside), once for pages of a host with the same html."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(h, p, *s) for h, p, source in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html"))) for s in subtrees(source or "")]
            names, kinds = ["host", "page", "hash", "inside"], (pa.string(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)], names)

    keyed = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html")
    return keyed.mapInArrow(cut, "host string, page long, hash long, inside boolean").distinct()


def recurring(pages: DataFrame) -> DataFrame:
    """pages(url, html) to (host, hash, inside) of the subtrees that belong to a host's template. Pages with the same html
    count once. Counting is by host and hash, with partial sums, so that a host with a third of all pages is spread."""
    keyed = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))
    different = keyed.distinct().groupBy("host").agg(F.count("*").alias("pages"))
    seen = page_subtrees(pages).groupBy("host", "hash", "inside").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES)
    least = F.when(F.col("inside"), ARTICLE_SHARE * F.col("pages")).otherwise(F.least(SHARE * F.col("pages"), F.lit(float(MANY_PAGES))))
    return seen.join(different, "host").where(F.col("n") >= least).select("host", "hash", "inside")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Null and empty html, and pages without main text, give an empty text. Rows with null url are one host of their own.
    Repeated rows give repeated results; an empty table gives no rows.
    """
    templates = stage_table(recurring(pages), "templates")
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    few = templates.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES
    site = F.xxhash64(host(F.col("url")))
    if few:
        known = frozenset((r["site"], r["hash"], r["inside"]) for r in templates.select(F.xxhash64("host").alias("site"), "hash", "inside").collect())
        rows = pages.select("page_id", "url", "html", site.alias("site"), F.lit(None).cast("array<struct<hash:bigint,inside:boolean>>").alias("own"))
    else:
        # each page's own list, by way of its subtrees; templates are repeated for 16 salts, so that a hot one is spread
        known = frozenset()
        seen = page_subtrees(pages).withColumn("salt", F.pmod("page", F.lit(16)))
        salted = templates.withColumn("salt", F.explode(F.array(*[F.lit(i).cast("long") for i in range(16)])))
        own = seen.join(salted, ["host", "hash", "inside", "salt"]).groupBy("host", "page").agg(F.collect_set(F.struct("hash", "inside")).alias("own"))
        own = own.select(F.col("host").alias("_h"), F.col("page").alias("_p"), "own")
        rows = pages.withColumn("_host", host(F.col("url"))).withColumn("_page", F.xxhash64("html"))
        rows = rows.join(own, (F.col("_host") == F.col("_h")) & (F.col("_page") == F.col("_p")), "left").select("page_id", "url", "html", site.alias("site"), "own")

    def texts(batches):
        import pyarrow as pa

        by_site: dict[int, set] = {}
        for s, h, inside in known:
            by_site.setdefault(s, set()).add((h, inside))
        for b in batches:
            out = []
            for s, source, own in zip(b.column("site").to_pylist(), b.column("html").to_pylist(), b.column("own").to_pylist()):
                out.append(main_text(source, {(x["hash"], x["inside"]) for x in own} if own else by_site.get(s, ())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(texts, schema)


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
