"""Main text of web pages by site style trees.

The pages of a host are merged: their elements fall together where their style
paths (tags and classes from the root) are the same. A branch has two importances.
Its presentation importance is the entropy of the ways in which its own elements
follow each other on the pages that have it: 0 where they always do alike. Its
content importance is 1 less the mean entropy of the texts below it over those
pages: texts that return on every page carry nothing, texts of one page carry all.
The more ways a branch is laid out in, the more the first counts; together they are
believed the more, the more pages there are. Branches of low importance are removed
from every page.

Markup is a prior: what names a branch navigation, advert, form or comments by tag,
class or role multiplies its importance by MARKUP, which leaves it below LEAST
whatever its texts are, since comments and adverts differ from page to page as an
article does. Such branches therefore never enter the tree. The article (or main)
element of a page, where it has one, bounds its content, and branches below it are
measured by its own importance: what repeats where the article does not is removed,
and an article that itself repeats (copies of a page) stays. Pages without it rest
on the tree alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelark.llm.storage import cut

#: Elements whose text is one block or more. Fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li "
    "main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style textarea title xmp noscript noembed noframes iframe template".split())
#: Elements that say what they hold: none of it is content.
CHROME = frozenset("nav footer aside form button select option fieldset menu dialog svg canvas object audio video map head textarea datalist label".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of classes, ids and roles that name what is not content.
NOISE = re.compile(
    r"^(?:ads?|adv|advert\w*|adsense|banner|breadcrumbs?|byline-share|captcha|comments?|comment-?list|consent|contentinfo|cookies?|complementary|copyright|disqus|dialog|footer|form|gdpr|header|hidden|login|"
    r"masthead|menu\w*|modal|nav\w*|newsletter|notices?|notification|outbrain|pagination|pager|popup|privacy|promo\w*|related|recommend\w*|replies|reply|respond|search\w*|share\w*|sharing|sidebar\w*|signup|"
    r"skip|social\w*|sponsor\w*|subscribe|subscription|taboola|tags|teaser|toolbar|tooltip|widget\w*|alert|overlay|paywall|toc|topbar|navbar|sitemap|reviews?|feedback|discussion)$"
)
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
#: A branch below LEAST goes; MARKUP is the prior of one that its markup names as no content.
LEAST, MARKUP = 0.3, 0.25
#: A branch of n layouts has content for WEIGHT ** n of its importance.
WEIGHT = 0.9
#: What hangs deeper belongs to the branch above it, so that the paths of a page have a bound.
DEPTH = 32
#: The first article or main of a path that goes on below it, in Python and in Spark.
ARTICLE = r"^(.*?>(?:article|main)(?:\.[^>]*)?)>"
#: Rows of all trees that are broadcast, and parts of a host's pages otherwise.
BROADCAST_ROWS, SALT = 200_000, 32


def style(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's name in the tree, and whether its markup names it as no content."""
    noise, names = tag in CHROME, []
    if attributes and not attributes.isspace():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role"):
                for word in value.split():
                    names.append(("#" if name == "id" else "") + re.sub(r"\d+", "", word))
                    parts = re.split(r"[-_:]", word)
                    if tag not in ("html", "body", "article", "main") and any(NOISE.match(x) for x in (word, *parts)):
                        noise = True
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                noise = True
    return ".".join([tag, *sorted(names)]), noise


def blocks(html: str | None, layouts: dict[str, list[str]] | None = None) -> list[tuple[str, str, bool, bool]]:
    """(style path, text, markup says noise, inside article or main) of all blocks in page order.

    ``layouts`` takes the names of the elements below each style path, in page
    order, but for what markup says is noise.

    Forgiving like a browser: unclosed and stray tags, truncated pages and
    attributes with markup in them are all read. Character references are decoded,
    white space is one space, empty blocks are none.
    """
    html = html or ""
    lower = html.lower() if "<" in html else ""

    def below(path: str, name: str) -> str:
        return f"{path}>{name}" if path.count(">") < DEPTH else path

    lower = lower if len(lower) == len(html) else html
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path, noise, in article
    out: list[tuple[str, str, bool, bool]] = []
    words: list[str] = []

    def close_block() -> None:
        if words:
            text = " ".join(unescape("".join(words)).split())
            if text:
                _, path, noise, inside = stack[-1] if stack else ("", "", False, False)
                out.append((path, text, noise, inside))
            words.clear()

    at = 0
    while True:
        m = TOKEN.search(html, at)
        if not m:
            words.append(html[at:])
            break
        if m.start() > at:
            words.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag in RAW and not m[1]:
            end = lower.find(f"</{tag}", at)
            gt = html.find(">", end) if end >= 0 else -1
            at = gt + 1 if gt >= 0 else len(html)
            continue
        if tag == "br":
            close_block()
            continue
        if tag not in BLOCKS and tag not in CHROME:
            if not m[1] and tag not in VOID:
                name, noise = style(tag, m[3])
                if noise:  # an inline element of noise has its own block
                    close_block()
                    top = stack[-1] if stack else ("", "", False, False)
                    stack.append((tag, below(top[1], name), True, top[3]))
            elif m[1] and stack and stack[-1][0] == tag:
                close_block()
                stack.pop()
            continue
        close_block()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID or m[3].endswith("/") and tag in ("hr",):
            continue
        if tag in CLOSED_BY:
            stop = {"li": ("ul", "ol", "menu"), "option": ("select",), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in stop:
                    break
                if stack[i][0] in CLOSED_BY[tag]:
                    del stack[i:]
                    break
        if tag in BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
        name, noise = style(tag, m[3])
        top = stack[-1] if stack else ("", "", False, False)
        if tag == "header":
            noise = noise or not top[3]
        if layouts is not None and not (noise or top[2]):
            layouts.setdefault(top[1], []).append(name)
            layouts.setdefault(below(top[1], name), [])
        stack.append((tag, below(top[1], name), noise or top[2], top[3] or tag in ("article", "main") and not (noise or top[2])))
    close_block()
    return out


def host(url: str | None) -> str:
    """The host of a URL in lower case, without port; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def branches(path: str) -> list[str]:
    """A path and all that it hangs from below the root."""
    steps = path.split(">")
    return [">".join(steps[:i]) for i in range(2, len(steps) + 1)]


def below_article(path: str) -> list[str]:
    """The branches of a path below its first article or main; none if it does not go on below one."""
    m = re.match(ARTICLE, path)
    return [b for b in branches(path) if len(b) > len(m[1])] if m else []


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By parts, on how many pages of a host each text, and each layout, of each style path stands."""
    for batch in batches:
        seen: dict[tuple[str, str, bool, int], int] = {}
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            layouts: dict[str, list[str]] = {}
            own = {(p, True, _hash(t)) for p, t, noise, _ in blocks(html, layouts) if not noise}
            own |= {(p, False, _hash(">".join(names)) if names else 0) for p, names in layouts.items() if p}
            name = host(url)
            for key in own:
                seen[name, *key] = seen.get((name, *key), 0) + 1
        keys = list(seen)
        columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([seen[k] for k in keys], pa.int64())], ["host", "path", "is_text", "feature", "pages"])


def site_trees(pages: DataFrame) -> DataFrame:
    """(host, weak): per host the branches of low importance, of the pages' merged style trees.

    Of a branch on m pages, the entropy of a text on k of them is log k / log m and
    its content importance 1 less the mean over all places of texts below it; its
    presentation importance is the entropy, to base m, of the share of pages that
    have each layout. What they lack together of 1 counts by (m - 1) / (m + 1),
    so a branch of one page has importance 1 and one that repeats on six pages none
    of any use. A branch is weak below LEAST, or, inside an article, below that
    share of the article's importance.
    """
    parts = pages.mapInArrow(_features, "host string, path string, is_text boolean, feature long, pages long")
    each = parts.groupBy("host", "path", "is_text", "feature").agg(F.sum("pages").alias("k"))
    k_log_k = F.sum(F.col("k") * F.log(F.col("k").cast("double")))
    # The feature 0 of a layout is that of no element below.
    laid_out = F.count_if(~F.col("is_text") & (F.col("feature") != 0))
    nodes = cut(each.groupBy("host", "path", "is_text").agg(F.sum("k").alias("places"), k_log_k.alias("logs"), laid_out.alias("layouts")))
    steps = F.split("path", ">")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), ">"))
    texts = nodes.where(F.col("is_text") & (F.col("path") != "")).select("host", F.explode(above).alias("branch"), "places", "logs")
    content = texts.groupBy("host", "branch").agg(F.sum("places").alias("places"), F.sum("logs").alias("text_logs"))
    layouts = nodes.where(~F.col("is_text")).select("host", F.col("path").alias("branch"), F.col("places").alias("m"), F.col("logs").alias("layout_logs"), "layouts")
    log_m = F.log(F.col("m").cast("double"))
    shown = F.when(F.col("m") > 1, (log_m - F.col("layout_logs") / F.col("m")) / log_m).otherwise(1.0)
    held = F.when(F.col("m") > 1, 1 - F.col("text_logs") / F.col("places") / log_m).otherwise(1.0)
    by_text = F.pow(F.lit(WEIGHT), F.col("layouts"))
    believed = (F.col("m") - 1) / (F.col("m") + 1)
    importance = 1 - (1 - (1 - by_text) * shown - by_text * held) * believed
    article = F.regexp_extract(F.concat("branch", F.lit(">")), ARTICLE, 1)
    valued = content.join(layouts, ["host", "branch"]).select("host", "branch", importance.alias("importance"), article.alias("article"))
    whole = F.max(F.when(F.col("branch") == F.col("article"), F.col("importance"))).over(Window.partitionBy("host", "article"))
    weak = valued.withColumn("whole", whole).where(F.col("importance") < LEAST * F.when(F.col("branch") != F.col("article"), F.coalesce("whole", F.lit(1.0))).otherwise(1.0))
    return weak.groupBy("host").agg(F.sort_array(F.collect_set("branch")).alias("weak"))


def main_text(html: str | None, weak: frozenset[str]) -> str:
    """The page's blocks that remain, a line each."""
    kept = [(path, text, inside) for path, text, noise, inside in blocks(html) if not noise]
    if any(inside for *_, inside in kept):
        own = [(path, text) for path, text, inside in kept if inside]
        if not weak:
            return "\n".join(text for _, text in own)
        return "\n".join(text for path, text in own if not weak.intersection(below_article(path)))
    if not weak:
        return "\n".join(text for _, text, _ in kept)
    return "\n".join(text for path, text, _ in kept if not weak.intersection(branches(path)))


def _extracted(batches: Iterator[pa.RecordBatch], trees=None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts = [host(u) for u in batch.column("url").to_pylist()]
        if trees is not None:
            weak = [trees.value.get(h, frozenset()) for h in hosts]
        else:
            weak = [frozenset(w or ()) for w in batch.column("weak").to_pylist()]
        texts = [main_text(h, w) for h, w in zip(batch.column("html").to_pylist(), weak, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``.

    ``text`` has the main text's blocks joined by a line feed, empty if there are
    none; ``n_chars`` its code points. Null or empty html gives an empty text; a
    page without a host is of the host ''. Pages of any length are read whole;
    repeated rows are rows of their own (and count as pages of their host); an
    empty table gives an empty one; other columns are never read.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, text string, n_chars long"
    trees = cut(site_trees(rows.select("url", "html")))
    if (trees.select(F.sum(F.size("weak"))).first()[0] or 0) <= BROADCAST_ROWS:
        held = spark.sparkContext.broadcast({r.host: frozenset(r.weak) for r in trees.collect()})
        return rows.mapInArrow(partial(_extracted, trees=held), schema)
    # Many sites: their trees meet the pages by host, a host's pages in SALT parts.
    salted = trees.select("host", "weak", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("part"))
    name = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    met = rows.withColumns({"host": name, "part": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")}).join(salted, ["host", "part"], "left")
    return met.select("page_id", "url", "html", "weak").mapInArrow(_extracted, schema)
