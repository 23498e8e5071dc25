"""Main text of web pages: the contiguous region with the largest sum of word and tag scores."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from granary.llm.common import carried, map_carrying, parts, table

#: At most about so many pages, spread by a hash, are read to learn weights; so many names of a kind reach the driver, the most frequent.
MAX_LABELLED, MAX_NAMES = 4000, 2000
#: Limits of the weights of words; what a tag costs, at most, and what it costs inside of an article and where labelled pages don't know it.
WORD_WEIGHTS, TAG_COST, NEUTRAL = (0.2, 1.0), 1.5, 0.02
#: What tags cost at most that by the standard say nothing of their content.
GENERIC_COST = 0.1
#: What it costs to enter and again to leave a part that is no article text.
ASIDE_COST = 0.4
#: Log-odds from which on a class or id is taken to name article text, or below whose negative to name none; names seen around fewer words have none.
DECISIVE, LEAST_SEEN = 2.0, 20

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|<(?=[a-zA-Z/])[^>]*(?:>|$)", re.S)
#: Whole names with their own values, so nothing inside a value is read as a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]{2,}")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
GENERIC = INLINE - {"a"} | frozenset("html body main article div section p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th blockquote pre figure figcaption br hr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("td th br wbr img".split())
ENDS_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements and roles that by the HTML and ARIA standards hold no text of the article around them.
OUTER = frozenset("head nav footer aside form button select dialog object applet map audio video canvas".split())
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Of these, only outside of an article.
OUTER_UNLESS_INSIDE = frozenset("header".split())
#: What a class or id that ends in such a name is taken to be where no labelled page knows it.
PRIOR_NAMES = frozenset("ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments cookie cookies consent copyright disclaimer disqus footer login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion promoted recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets".split())
#: Words of a class or id that make it say what its element has or lacks, not what it is.
STATES = frozenset("has have no not with without show shows hide hides enable disable".split())

Weights = dict[tuple[str, str], float]


def parse(page: str) -> list[tuple[str, str, object]]:
    """('text', decoded text, its number of words), ('open', tag, its attributes as text), ('close', tag, '') and ('void', tag, '').

    Opens and closes are balanced: ends of elements that were never closed are inferred from the end of an element
    around them, and of paragraphs and list items from the next block; ends of what isn't open are passed over. The
    time is linear: of open elements only counts by name and the nearest that is not inline are looked at.
    """
    out: list[tuple[str, str, object]] = []
    stack: list[str] = []
    blocks: list[int] = []  # where in the stack elements lie that are not inline
    opened: dict[str, int] = {}

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            name = stack.pop()
            opened[name] -= 1
            if blocks and blocks[-1] == len(stack):
                blocks.pop()
            out.append(("close", name, ""))

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = page[at:stop]
            text = entities.unescape(text) if "&" in text else text
            out.append(("text", text, len(text.split())))
        if not m:
            break
        at = m.end()
        if m[1] is None:
            continue
        name = m[1].lower()
        if page[m.start() + 1] == "/":
            if opened.get(name):
                while stack[-1] != name:
                    close_to(len(stack) - 1)
                close_to(len(stack) - 1)
            continue
        if name in ENDS_P:
            if blocks and stack[blocks[-1]] == "p":
                close_to(blocks[-1])
        elif name == "li":
            inner = len(blocks) > 1 and stack[blocks[-1]] == "p"
            if blocks and stack[blocks[-1 - inner]] == "li":
                close_to(blocks[-1 - inner])
        if name in VOID:
            out.append(("void", name, ""))
        elif name in RAW:
            if not (name in ("svg", "math") and m[2].endswith("/")):  # elements of other languages may close themselves
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = close.end() if close else end
        else:
            out.append(("open", name, m[2]))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(name)
            opened[name] = opened.get(name, 0) + 1
    close_to(0)
    return out


def attributes_of(text: str) -> tuple[bool, list[str]]:
    """Whether an element isn't shown or has the role of something other than article text; and the words of its class and id, in lower case."""
    names: list[str] = []
    for key, value in ATTRIBUTE.findall(text):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "role" and value in OUTER_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, []
        if key in ("class", "id"):
            names += value.split()
    return False, names


def name_weight(name: str, weights: Weights, also: frozenset[str] = frozenset()) -> float:
    """Log-odds that words in an element of that class or id are article text: what labelled pages say of it, else what its last part says."""
    found = weights.get(("name", name))
    if found is not None:
        return found
    words = NAME.findall(name)
    return -DECISIVE if words and STATES.isdisjoint(words) and (words[-1] in PRIOR_NAMES or words[-1] in also) else 0.0


def parts_left_out(tokens: list[tuple[str, str, object]], weights: Weights, by_name: bool = True) -> dict[int, int]:
    """Where elements that are no article text begin and end: by the standards, or by what their class or id weighs.

    A class or id doesn't count on html, body, main and article, beside another one that names article text, nor on an
    element that holds most words of the page.
    """
    stack: list[tuple[int, int, int]] = []  # where it began, after how many words, why: 0 no, 1 by the standards, 2 by a name
    found: list[tuple[int, int, int, int]] = []
    words = inside = 0
    for k, (kind, name, value) in enumerate(tokens):
        if kind == "text":
            words += value
        elif kind == "open":
            why = int(name in OUTER or name in OUTER_UNLESS_INSIDE and not inside)
            if value and not why:
                hidden, names = attributes_of(value)
                why = int(hidden)
                if by_name and names and name not in ("html", "body", "main", "article"):
                    said = [name_weight(x, weights, OUTER_UNLESS_INSIDE if not inside and name not in HEADINGS else frozenset()) for x in names]
                    why = 2 if min(said) <= -DECISIVE and max(said) < DECISIVE else 0
            stack.append((k, words, why))
            inside += name in ("article", "main")
        elif kind == "close":
            began, before, why = stack.pop()
            if why:
                found.append((began, k, why, words - before))
            inside -= name in ("article", "main")
    return {a: b for a, b, why, held in found if why == 1 or 2 * held <= words}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words by the block around them, tags, and words by the class or id around them lie inside and outside of the article of labelled pages."""
    for batch in parts(batches, 500):
        counts: dict[tuple[str, str], list[int]] = {}

        def add(kind: str, name: str, own: int, n: int, counts=counts) -> None:
            c = counts.setdefault((kind, name), [0, 0])
            c[0] += own
            c[1] += n

        for page in batch.column(0):
            tokens = parse(page.as_py())
            outer = parts_left_out(tokens, {}, by_name=False)  # what names say is to be learned
            block, inside, until, words, own = "body", 0, -1, 0, 0
            stack: list[tuple[list[str], int, int]] = []
            for k, (kind, name, value) in enumerate(tokens):
                if kind == "text":
                    if value:
                        mine = value if inside and k > until else 0
                        words, own = words + value, own + mine
                        add("word", block, mine, value)
                    continue
                add("tag", name, int(inside > 0 and k > until), 1)
                if kind == "close":
                    names, words0, own0 = stack.pop()
                    for x in names:
                        add("name", x, own - own0, words - words0)
                    inside -= name in ("article", "main")
                    continue
                if name not in INLINE:
                    block = name
                if kind == "open":
                    names = attributes_of(value)[1] if value else []
                    until = max(until, outer.get(k, -1))
                    stack.append((names, words, own))
                    inside += name in ("article", "main")
        rows = [(*k, *n) for k, n in counts.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["kind", "name", "own", "n"])


def learn_weights(pages: DataFrame, max_pages: int = MAX_LABELLED, max_names: int = MAX_NAMES) -> Weights:
    """Weights by ('word', block), ('tag', name) and ('name', class or id), from pages that label their own text: one article or main element.

    A word weighs more the more often words in such a block are article text; a tag costs more the more often it lies
    outside of it; a name says what share of the words around which it lies are article text. What reaches the driver is
    a row for each name seen LEAST_SEEN times or more, at most max_names of a kind.
    """
    n = max(1, pages.count())
    spread = F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)) < int(min(1.0, max_pages / n) * (1 << 20))
    labelled = pages.where(spread & (F.regexp_count("html", F.lit(r"(?i)<(article|main)[\s>]")) == 1)).select("html")
    counts = labelled.mapInArrow(_count, "kind string, name string, own long, n long").groupBy("kind", "name").agg(F.sum("own").alias("own"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name"))
    weights: Weights = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= max_names).collect():
        odds = math.log((r["own"] + 1) / (r["n"] - r["own"] + 1))
        low, high = WORD_WEIGHTS
        weights[r["kind"], r["name"]] = {"word": min(high, max(low, odds)), "tag": min(GENERIC_COST if r["name"] in GENERIC else TAG_COST, max(NEUTRAL, -odds)), "name": odds}[r["kind"]]
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, (0, 0) if none is positive, in one pass."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, span = total, (start, k + 1)
    return span


def scored(page: str, weights: Weights) -> tuple[list[float], list[int], list[list[str]]]:
    """The score of every event of a page that is no part left out; the block of each that has words, else -1; and the pieces of every block's text.

    Words score by their block, tags and parts that are left out cost. Where articles hold at least half of the words
    that are left, words beside them score negative, and a tag inside costs as little as any.
    """
    tokens = parse(page)
    outer = parts_left_out(tokens, weights)
    blocks: list[list[str]] = [[]]
    where: list[int] = []
    scores: list[float] = []
    beside: list[tuple[int, int]] = []  # events of words outside of articles
    block, inside, within, k = "body", 0, 0, 0
    while k < len(tokens):
        kind, name, value = tokens[k]
        if kind == "text":
            blocks[-1].append(name)
            if value:
                if inside:
                    within += value
                else:
                    beside.append((len(scores), value))
                scores.append(value * weights.get(("word", block), WORD_WEIGHTS[1]))
                where.append(len(blocks) - 1)
            k += 1
            continue
        if until := outer.get(k):
            scores.append(-2 * ASIDE_COST if not inside else -NEUTRAL)
        else:
            scores.append(-weights.get(("tag", name), NEUTRAL) if not inside else -NEUTRAL)
        where.append(-1)
        if name in CELLS:
            blocks[-1].append(" ")
        elif name not in INLINE:
            if blocks[-1]:
                blocks.append([])
            if kind != "close":
                block = name
        if not until:
            inside += (kind == "open") - (kind == "close") if name in ("article", "main") else 0
        k = until + 1 if until else k + 1
    if within and within >= sum(n for _, n in beside):
        for at, n in beside:
            scores[at] = -float(n)
    return scores, where, blocks


def main_text(page: str | None, weights: Weights) -> str:
    """The text of the best region's blocks, joined by empty lines."""
    if not page:
        return ""
    scores, where, blocks = scored(page, weights)
    low, high = best_region(scores)
    chosen = sorted({b for b in where[low:high] if b >= 0})
    found = (" ".join("".join(blocks[b]).split()) for b in chosen)
    return "\n\n".join(x for x in found if x)


def extract_text(pages: DataFrame, carry: list[str] | None = None, weights: Weights | None = None) -> DataFrame:
    """The carried columns (all by default) and text, n_chars of every page's main text.

    Null and empty pages, and pages without article text, have an empty text. Weights come from the pages that label
    themselves unless they are given; without any, every word weighs the same and every tag costs the same. Each row is
    read alone: ties and repeated rows change nothing; an empty table gives an empty result.
    Columns of pages named text or n_chars give way to those of the result.
    """
    carry = carried(pages.columns if carry is None else carry, ("text", "n_chars"))
    weights = learn_weights(pages) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 500):
            found = [main_text(page.as_py(), weights) for page in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*batch.schema.names[1:], "text", "n_chars"])

    return map_carrying(pages, F.col("html").cast("string"), carry, run, "text string, n_chars long")


def op2_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])
