"""Operator 3: main text of web pages by template deduction over the pages of a host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieline.llm.common import cut, drop, hash_udf_free_key, small_side, sweep, table

#: A class of tokens is part of a host's template if at least so many different pages of the host have it, and this
#: share of them; a class needs so many tokens to count.
MIN_PAGES, MIN_SHARE, MIN_TOKENS = 4, 0.5, 2
#: Salts that the pages of one host are dealt over when templates are joined to pages.
SALTS = 32
#: Tokens of all templates together up to which they are broadcast (8 bytes each); beyond, pages are shuffled to them.
BROADCAST_TOKENS = 1_000_000

# HTML elements by their role.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
OUTSIDE = {"nav", "aside", "footer", "form", "script", "style", "noscript", "template", "head", "button", "select", "textarea", "iframe", "svg", "dialog", "menu", "title", "object", "canvas", "label", "option"}
MAIN = {"article", "main"}
#: An element closes these open ones when it starts.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INLINE_STOP = BLOCKS - {"p", "li", "dt", "dd"}

# Whole words of a class, id or role that name what the contract leaves out: adverts, notices, menus, side
# and foot matter, forms, reader comments. A longer word that only begins like one (related-work, notice-of-law) names none.
NOISE = re.compile(
    r"(?:(?:google|site|page|main|top|bottom|global|user|reader|article|post|entry)[-_])?(?:ads?|advert(?:s|isement|isements|ising|orial)?|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|banner|cookies?|consent|gdpr|notices?|popup|modal"
    r"|newsletter|subscribe|signup|login|share|sharing|social|sidebar|side-bar|widgets?|related|recommended|recommendations|breadcrumbs?|menu|navbar|nav|navigation|pagination|pager|comments?|respond|replies|disqus|footer|masthead"
    r"|topbar|toolbar|searchbar|search-form|skip-link|complementary|contentinfo|header(?=$)(?<=site-header))"
    r"(?:[-_](?:ads?|bar|banner|box|block|area|list|section|container|wrapper|links?|posts?|articles|stories|form|notice|consent|buttons?|icons|menu|nav|thread|respond|inner|top|bottom|left|right|slot|unit|\d+))*"
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r">|=\s*[\"']")
SPACES = re.compile(r"\s+")
CELLS = {"tr", "td", "th"}


def noisy_words(value: str) -> bool:
    return any(NOISE.fullmatch(w) for w in value.split())


class Block:
    """A run of text between block borders: its token, its element's token, whether it lies outside the main text, whether inside a main element."""

    __slots__ = ("token", "parent", "at", "outside", "inside", "text")

    def __init__(self, token: int, parent: int, at: int, outside: bool, inside: bool, text: str):
        self.token, self.parent, self.at, self.outside, self.inside, self.text = token, parent, at, outside, inside, text


def token_of(text: str, parent: int) -> int:
    """A 63-bit hash of a token below its parent's, equal in every process; a path is hashed step by step."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=parent) >> 1


class Scanner:
    """Finds the ends of tags in one pass over a page: quotes count after '=' only, and only if they close."""

    def __init__(self, page: str):
        self.page, self.unclosed, self.plain = page, set(), False

    def end(self, at: int) -> int:
        """Place of the '>' that ends the tag open at ``at``, or -1 if no '>' follows."""
        start = at
        while not self.plain:
            m = STOP.search(self.page, at)
            if not m:
                self.plain = True  # no end outside of quotes: from here on, quotes are not looked at
                break
            if m[0] == ">":
                return m.start()
            at, quote = m.end(), m[0][-1]
            if quote not in self.unclosed:
                close = self.page.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)
                else:
                    at = close + 1
        return self.page.find(">", start)


def parse(page: str) -> tuple[list[tuple[int, int]], list[Block]]:
    """(tag tokens with their parents', text blocks) of a page, both in page order. Unclosed and stray tags are tolerated.

    Time and memory follow the page's length: paths are hashes, and open elements are found by name.
    """
    tags: list[tuple[int, int]] = []
    blocks: list[Block] = []
    stack: list[tuple[str, int, bool, bool, tuple[int, bool, bool]]] = []  # name, path, outside, inside, what its text belongs to
    opened: dict[str, list[int]] = {}
    walls: list[int] = []  # places of open block elements, and of those of them that are no table cells
    far_walls: list[int] = []
    parts: list[str] = []
    top = (0, False, False)
    scan = Scanner(page)
    at, size = 0, len(page)

    def flush() -> None:
        if parts:
            text = SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                path, outside, inside = stack[-1][4] if stack else top
                blocks.append(Block(token_of(text, path), path, len(tags) + len(blocks), outside, inside, text))

    def shut(upto: int) -> None:
        while len(stack) > upto:
            opened[stack.pop()[0]].pop()
        for w in (walls, far_walls):
            while w and w[-1] >= upto:
                w.pop()

    while at < size:
        open_at = page.find("<", at)
        if open_at < 0:
            parts.append(page[at:])
            break
        if open_at > at:
            parts.append(page[at:open_at])
        if page.startswith("<!--", open_at):
            close = page.find("-->", open_at + 4)
            at = close + 3 if close >= 0 else size
            continue
        if page.startswith("<![CDATA[", open_at):
            close = page.find("]]>", open_at)
            parts.append(entities.escape(page[open_at + 9: close if close >= 0 else size], quote=False))
            at = close + 3 if close >= 0 else size
            continue
        m = NAME.match(page, open_at + 1)
        odd = page[open_at + 1: open_at + 2] in ("!", "?")
        close = (page.find(">", open_at) if odd else scan.end(m.end())) if m or odd else -1
        if close < 0:
            parts.append("<")
            at = open_at + 1
            if m or odd:  # no '>' follows at all: the rest is text
                parts.append(page[at:])
                break
            continue
        at = close + 1
        if odd:
            continue
        name = m[1].lower()
        if m[0][0] == "/":
            if name in BLOCKS or name in OUTSIDE:
                flush()
            where = opened.get(name)
            if where and (name in INLINE_STOP or not walls or walls[-1] <= where[-1]):
                shut(where[-1])
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                parts.append(" " if name == "br" else "")
            continue
        if name in BLOCKS or name in OUTSIDE:
            flush()
        for other in CLOSES.get(name, ()):
            where, wall = opened.get(other), far_walls if name in CELLS else walls
            if where and (not wall or wall[-1] <= where[-1]):
                shut(where[-1])
        label, noisy, body = name, name in OUTSIDE, page[m.end(): close]
        if body.strip(" /\n\t"):
            for key, value in ATTRIBUTE.findall(body):
                value = value.strip("\"'").lower()
                key = key.lower()
                if key in ("hidden", "aria-hidden"):
                    noisy |= key == "hidden" or value == "true"
                elif value:
                    if key != "id":
                        label += f".{value}"
                    noisy |= name not in ("html", "body", *MAIN) and noisy_words(value)
        _, parent, outside, inside, holder = stack[-1] if stack else ("", 0, False, False, top)
        # A header is the site's, unless it stands in the article: there it holds the article's heading.
        noisy |= name == "header" and not inside
        path = token_of(label, parent)
        tags.append((path, parent))
        if body.endswith("/") and name not in BLOCKS:
            continue
        outside, inside = outside or noisy, inside or name in MAIN
        opened.setdefault(name, []).append(len(stack))
        if name in INLINE_STOP:
            walls.append(len(stack))
            if name not in CELLS:
                far_walls.append(len(stack))
        stack.append((name, path, outside, inside, (path, outside, inside) if name in BLOCKS or outside else holder))
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return tags, blocks


def extract(page: str | None, template: frozenset[int] | set[int]) -> str:
    """The page's slots: the blocks that are no token of the template, outside of everything that is no article."""
    if not page:
        return ""
    _, blocks = parse(page)
    inside = [b for b in blocks if b.inside and not b.outside]
    chosen = inside or [b for b in blocks if not b.outside]
    return "\n\n".join(b.text for b in chosen if b.token not in template)


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\s]*)", url or "", re.I)
    return m[1].lower().rpartition("@")[2] if m else ""


_VECTORS = "host string, token long, parent long, block boolean, pages long, total long, place long, vector long"

#: Sums over a host's different pages are taken modulo this prime: each of n copies of a page weighs 1/n there, so that
#: all of them together count exactly once, wherever they are read.
PRIME = (1 << 61) - 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors, modulo PRIME: of each host and token how many different pages have it, how often, the sum of
    its first places, and the sum over these pages of a hash of (page, count). Vectors are equal, but for hash collisions, if
    and only if these last sums are."""
    for batch in batches:
        found: dict[tuple[str, int], list] = {}
        copies = Counter(zip(*(batch.column(c).to_pylist() for c in ("host", "html", "copies"))))
        for (host, text, of), here in copies.items():
            share = 1 if of == here else here * pow(of, -1, PRIME) % PRIME
            key = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
            tags, blocks = parse(text)
            seen: dict[int, list] = {}
            for place, (token, parent) in enumerate(tags):
                seen.setdefault(token, [parent, False, place, 0])[3] += 1
            for b in blocks:
                seen.setdefault(b.token, [b.parent, True, b.at, 0])[3] += 1
            for token, (parent, block, place, n) in seen.items():
                row = found.setdefault((host, token), [parent, block, 0, 0, 0, 0])
                row[2] += share
                row[3] += n * share
                row[4] += place * share
                row[5] += xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=key) * share
        rows = [(h, t, p, b, *(x % PRIME for x in sums)) for (h, t), (p, b, *sums) in found.items()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _VECTORS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def template_nodes(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, token, parent, block, at): for each host the tokens of its template, nested and in order.

    Tokens (tags by their path, text blocks by their element's path) with one occurrence vector over the host's different
    pages form an equivalence class. A class is valid if MIN_PAGES pages and MIN_SHARE of the host's pages have it and it
    has MIN_TOKENS tokens. Valid classes nest by their tokens' parents: an element that holds tokens of a valid class belongs
    to the template though its own class is too small (the p of repeated paragraphs), and a token without a way up to the
    root has no place in it. ``at`` is a token's mean first place, which orders the
    children of a parent; between them lie the slots. Equal pages of a host count once, empty ones not at all. Vectors are
    summed where the pages are read, so a host with a third of all pages costs no more rows than it has distinct tokens.
    """
    source = pages.select(_host_column(url).alias("host"), F.col(page).cast("string").alias("html")).where("html <> ''").withColumn("digest", F.md5("html"))
    different = cut(source.groupBy("host", "digest").agg(F.count("*").alias("copies")))
    several = cut(different.where("copies > 1"))
    counted = source.join(small_side(several), ["host", "digest"], "left").select("host", "html", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
    parts = counted.mapInArrow(_vectors, _VECTORS)
    summed = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % F.lit(PRIME).cast("decimal(38,0)")).cast("long").alias(c)
    sums = parts.groupBy("host", "token", "parent", "block").agg(*(summed(c) for c in ("pages", "total", "place", "vector")))
    vectors = cut(sums.where(F.col("pages") >= MIN_PAGES))
    host_pages = different.groupBy("host").agg(F.count("*").alias("host_pages"))
    shape = ["host", "vector", "pages", "total"]
    classes = vectors.groupBy(*shape).agg(F.count("*").alias("tokens"))
    common = classes.join(host_pages, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages")).select(*shape, (F.col("tokens") >= MIN_TOKENS).alias("valid"))
    members = vectors.join(common, shape).select("host", "token", "parent", "block", (F.col("place") / F.col("pages")).alias("at"), "valid")
    # A host's common tokens stand on half of its pages, so a group is no larger than two of its pages.
    out = cut(members.groupBy("host").applyInPandas(_nested, members.drop("valid").schema))
    drop(different, several, vectors)
    return out


def _nested(tokens: pd.DataFrame) -> pd.DataFrame:
    """Of one host's common tokens those of valid classes and the elements that hold them, if they have a way up to the root."""
    parent = dict(zip(tokens.token, tokens.parent))
    placed: dict[int, bool] = {0: True}
    for t in tokens.token[tokens.valid]:
        way = []
        while t not in placed and t in parent:
            way.append(t)
            placed[t] = False  # until its parent is known
            t = parent[t]
        placed.update(dict.fromkeys(way, placed.get(t, False)))
    return tokens[tokens.token.map(lambda t: placed.get(t, False))].sort_values("at").drop(columns="valid")


def templates(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, tokens): for each host the hashes of the text blocks of its template: blocks that half of a host's pages share."""
    return template_nodes(pages, url, page).where("block").groupBy("host").agg(F.collect_set("token").alias("tokens"))


def _host_column(url: str):
    found = F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), "^\\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\s]*)", 1))
    return F.regexp_replace(found, "^.*@", "")


def _extract(passed: list[str], page: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t, set(known or ())) for t, known in zip(batch.column(page).to_pylist(), batch.column("_tokens").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in passed), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*passed, "text", "n_chars"]
            )

    return run


def extract_pages(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` with the page itself replaced by ``text``, its main text, and ``n_chars``, that text's code points.

    Text of a host's template (the same block on half of its different pages or more) and of elements that are no article goes
    (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments); the remaining slots are
    extracted, those inside article or main elements if there are any. Character references are decoded, white space
    in a block becomes one space, blocks are joined by two \\n. A null or empty page has an empty text; a null url is the
    host ''. Hosts with few pages have no template, so only the elements decide. Rows are kept as they are, repeated
    or not; columns named text and n_chars are replaced; an empty table stays empty.
    """
    passed = [c for c in pages.columns if c not in (page, "text", "n_chars", "_tokens", "_host", "_salt")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*passed).schema)
    known = cut(templates(pages, url, page))
    sweep(pages.sparkSession)
    size = known.agg(F.sum(F.size("tokens") + 1)).first()[0] or 0
    source = pages.select(*passed, F.col(page).cast("string").alias(page)).withColumn("_host", _host_column(url))
    if size <= BROADCAST_TOKENS:
        joined = source.join(F.broadcast(known.select(F.col("host").alias("_host"), F.col("tokens").alias("_tokens"))), "_host", "left")
    else:  # templates are copied over salts, so that the pages of one host are dealt out
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        source = source.withColumn("_salt", F.pmod(hash_udf_free_key(*passed, page), F.lit(SALTS)).cast("int"))
        joined = source.join(known.select(F.col("host").alias("_host"), "_salt", F.col("tokens").alias("_tokens")), ["_host", "_salt"], "left")
    return joined.mapInArrow(_extract(passed, page), f"{fields}, text string, n_chars bigint")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of all pages."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
