"""Main text of web pages: the best-scoring stretch of a page, words counting for it and tags against it."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import column, row_key, slices, written

# Tags with quoted values, comments, and elements whose content is not markup; whatever is unclosed runs to the page's end.
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|<[a-zA-Z][^>]*>|(?P<text>[^<]+|<)",
    re.S | re.I)
# A whole attribute: its name, then a quoted or bare value if it has one.
_ATTRIBUTE = re.compile(r"([^\s/=>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?|\"[^\"]*+\"|'[^']*+'")
_NAMING = frozenset(("class", "id", "role"))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that say what their content is for; others take it from those around them.
_CONTAINERS = frozenset("article main section nav aside header footer form dialog menu fieldset button select figure head address".split())

#: What is known before any page is read, as words seen inside and outside the main text.
PRIOR = {
    "article": (60.0, 1.0), "main": (40.0, 2.0), "section": (2.0, 2.0), "figure": (4.0, 2.0), "address": (2.0, 2.0), "nav": (1.0, 60.0), "aside": (1.0, 60.0), "header": (1.0, 30.0),
    "footer": (1.0, 60.0), "form": (1.0, 60.0), "dialog": (1.0, 60.0), "menu": (1.0, 60.0), "fieldset": (1.0, 40.0), "button": (1.0, 60.0), "select": (1.0, 60.0), "head": (1.0, 60.0)}
#: Parts of class, id and role names.
_AGAINST = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|banner|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|reply|responses?|cookies?|consent|gdpr|notices?|"
    r"alert|popup|modal|overlay|newsletter|subscribe\w*|subscription|social|share|sharing|related|recommend\w*|login|signup|search|widget|toolbar|pagination|pager|complementary|contentinfo|navigation)(?:$|[-_ ])", re.I)
_FOR = re.compile(r"(?:^|[-_ ])(?:article|articlebody|main|content|post|entry|story|body|text)(?:$|[-_ ])", re.I)
LIMIT = 4.0


def names_of(tag: str, attributes: str) -> list[str]:
    """What an element's weight hangs on: its tag if that is a container, and its class, id and role."""
    found = [tag] if tag in _CONTAINERS else []
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), "".join(values)
        if name in ("hidden", "aria-hidden"):
            found += ["hidden"] if value.lower() != "false" else []
        elif name in _NAMING:
            found += [f".{v.lower()}" for v in value.split()]
    return found


def prior_of(name: str) -> tuple[float, float]:
    if name in PRIOR:
        return PRIOR[name]
    if name == "hidden" or name[0] == "." and _AGAINST.search(name[1:]):
        return 1.0, 60.0
    return (20.0, 1.0) if name[0] == "." and _FOR.search(name[1:]) else (1.0, 1.0)


def _log_odds(inside: float, outside: float) -> float:
    return max(-LIMIT, min(LIMIT, math.log(inside / outside)))


def weight_of(names: list[str], weights: dict[str, float]) -> float | None:
    """For the main text if over 0, against it if under; None where the names say nothing."""
    known = [weights[n] if n in weights else _log_odds(*prior_of(n)) for n in names if n in weights or prior_of(n) != (1.0, 1.0)]
    return None if not known else min(known) if min(known) < 0 else max(known)


def read(page: str) -> Iterator[tuple[str, object, str]]:
    """("open" or "close", tag, attributes) and ("text", text, "") in page order."""
    for m in _TOKEN.finditer(page):
        if m["text"] is not None:
            yield "text", m["text"], ""
        elif m["name"]:
            name = m["name"].lower()
            yield ("close" if m["close"] else "open"), name, m["attributes"]
        elif m["raw"]:
            yield "raw", m["raw"].lower(), ""


def blocks(page: str, weights: dict[str, float] | None = None) -> Iterator[tuple[str, list[list[str]], float, int]]:
    """(text, names of the elements around it from the outside in, weight, tags since the block before), in page order.

    A block is the text between two block-level tags, its references decoded and its white space single. What is against the main
    text stays so for all it holds; elsewhere the innermost element that says something decides.
    """
    stack: list[tuple[str, list[str], float]] = [("", [], 0.0)]
    parts: list[str] = []
    tags = 0

    def flush() -> Iterator[tuple[str, list[list[str]], float, int]]:
        nonlocal tags
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield text, [names for _, names, _ in stack if names], stack[-1][2], tags
            tags = 0

    for kind, name, attributes in read(page):
        if kind == "text":
            parts.append(name)
            continue
        if kind == "raw":
            parts.append(" ")
            tags += 1
            continue
        own = names_of(name, attributes) if kind == "open" and name not in _VOID else []
        if name not in _INLINE or own:
            yield from flush()
        elif name == "br":
            parts.append(" ")
        tags += 1
        if kind == "open":
            if name not in _VOID and not attributes.rstrip().endswith("/"):
                if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and stack[-1][0] == name:
                    stack.pop()
                w = weight_of(own, weights or {}) if own else None
                before = stack[-1][2]
                stack.append((name, own, before if w is None or before < 0 else w))
        elif any(tag == name for tag, _, _ in stack):
            while stack[-1][0] != name:
                stack.pop()
            stack.pop()
    yield from flush()


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, by one scan; the longest of equal ones that starts first. Empty if no sum is over 0."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best > 0 and i + 1 - start > at[1] - at[0]:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, float], tag_cost: float) -> str:
    found = list(blocks(page or "", weights))
    nested = any(w > 0 for _, _, w, _ in found)
    scores = []
    for text, around, weight, tags in found:
        n = len(text.split())
        if weight < 0 and nested and any((weight_of(names, weights) or 0) > 0 for names in around):
            scores.append(0.0)  # an advert inside the article ends nothing
            continue
        plain = weight if weight else -0.5 if nested else 0.5
        scores.append(n * plain - min(tags * tag_cost, 0.9 * n * abs(plain)) if plain > 0 else n * plain - tags * tag_cost)
    a, b = best_region(scores)
    return "\n".join(text for text, _, weight, _ in found[a:b] if weight > 0 or weight == 0 and not nested)


def evidence(page: str | None) -> dict[str, list[int]]:
    """Words inside and outside the main text for each name, and tags by the same, on a page that labels itself.

    That is one with a single article element which isn't part of something else, such as the comments.
    """
    if not page or len(re.findall(r"<article[\s>]", page, re.I)) != 1:
        return {}
    seen: dict[str, list[int]] = {}
    for text, around, _, tags in blocks(page):
        flat = {n for names in around for n in names}
        inside = "article" in flat
        if inside and any("article" in around[i] and any((weight_of(names, {}) or 0) < 0 for names in around[: i + 1]) for i in range(len(around))):
            return {}
        for n, count in [*((n, len(text.split())) for n in flat), (" words", len(text.split())), (" tags", tags)]:
            seen.setdefault(n, [0, 0])[0 if inside else 1] += count
    return seen


def names_in(page: str | None) -> set[str]:
    """Classes, ids and roles of all elements of a page."""
    found = {(name, attributes) for kind, name, attributes in read(page or "") if kind == "open" and name not in _VOID and attributes}
    return {n for tag, attributes in found for n in names_of(tag, attributes) if n[0] == "."}


def _weight(name: str, inside: int, outside: int) -> float:
    a, b = prior_of(name)
    return _log_odds(a + inside, b + outside)


def learned(pages: DataFrame, html_column: str, most_names: int) -> tuple[dict[str, float], float, DataFrame | None]:
    """Weights of names, and what a tag costs, from all pages that label themselves.

    Weights of tags and of the `most_names` commonest other names come as a dict; the counts of the names beyond them as a table
    (name, inside, outside), or None if there are none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, html_column):
            total: dict[str, list[int]] = {}
            for page in column(piece, html_column).to_pylist():
                for name, (a, b) in evidence(page).items():
                    row = total.setdefault(name, [0, 0])
                    row[0] += a
                    row[1] += b
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())],
                names=["name", "inside", "outside"])

    counts = written(
        pages.select(html_column).mapInArrow(run, "name string, inside long, outside long").groupBy("name").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")))
    dotted, words_in = F.col("name").startswith("."), F.col("inside") + F.col("outside")
    # Tags are a fixed few; the other names are as many as the pages make them.
    rows = counts.where(~dotted).collect()
    common = counts.where(dotted).orderBy(words_in.desc(), "name").limit(most_names + 1).collect()
    rest = None
    if len(common) > most_names:
        edge = common.pop()
        size = edge.inside + edge.outside
        rest = counts.where(dotted & ((words_in < size) | (words_in == size) & (F.col("name") >= edge.name)))
    seen = {r.name: (r.inside, r.outside) for r in [*rows, *common]}
    words, tags = seen.pop(" words", (0, 0)), seen.pop(" tags", (0, 0))
    weights = {name: _weight(name, *seen.get(name, (0, 0))) for name in {*seen, *PRIOR}}
    # Tags per word outside against inside, as a cost for each tag.
    rate = ((tags[1] + 1) / (words[1] + 1)) / ((tags[0] + 1) / (words[0] + 1))
    return weights, max(0.05, min(1.0, math.log(max(rate, 1.0)) / 4)), rest


def _with_own_names(plain: DataFrame, weights: dict[str, float], rest: DataFrame) -> DataFrame:
    """The pages with `own`: the counts of those of their names that are not among the weights."""
    keyed = plain.select("*", *row_key("page_id", "html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html"):
            found = [sorted(names_in(page) - weights.keys()) for page in column(piece, "html").to_pylist()]
            per = pa.array([i for i, names in enumerate(found) for _ in names], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [column(piece, "key_a").take(per), column(piece, "key_b").take(per), pa.array([n for names in found for n in names], pa.string())], names=["key_a", "key_b", "name"])

    own = keyed.select("key_a", "key_b", "html").mapInArrow(run, "key_a long, key_b long, name string").join(rest, "name")
    own = own.groupBy("key_a", "key_b").agg(F.collect_set(F.struct("name", "inside", "outside")).alias("own"))
    return keyed.join(own, ["key_a", "key_b"], "left").select("page_id", "url", "html", "own")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html", most_names: int = 5000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars; text is the page's main text, its blocks joined by a newline.

    Words of a block score by the elements around it, with weights counted on all pages that hold one article element (and on
    fixed counts for elements and names that such pages lack); tags cost. The stretch of blocks with the largest sum is the main
    text. Inside it, blocks of elements that count against it (menus, adverts, forms, comments and so on) are left out.

    A page is read alone, in slices of a few MB; only counts of names are shuffled while there are at most `most_names` of them.
    The weights of so many travel with the code; each page's own names beyond them are joined with the table of counts, and the
    pages are shuffled once for it, so every counted name has its weight. A null or empty page, and one without a block that
    scores, has an empty text. Ids and urls may be null or repeat; other columns are not read.
    """
    plain = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html_column).alias("html"))
    weights, cost, rest = learned(plain, "html", most_names)
    joined = rest is not None
    if joined:
        plain = _with_own_names(plain, weights, rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "html"):
            owns = column(piece, "own").to_pylist() if joined else [None] * piece.num_rows
            texts = []
            for page, own in zip(column(piece, "html").to_pylist(), owns):
                known = weights | {r["name"]: _weight(**r) for r in own} if own else weights
                texts.append(main_text(page, known, cost))
            yield pa.RecordBatch.from_arrays(
                [column(piece, "page_id"), column(piece, "url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
