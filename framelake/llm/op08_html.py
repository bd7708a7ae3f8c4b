"""Main text of web pages as the best-scoring run of words and tags."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import as_bytes, over_batches, row_batch

#: About this many labelled pages (those with one article or main element), and never twice as many, teach the weights,
#: picked by a hash of the page.
LABELLED_PAGES = 4000
WORD_RANGE, TAG_RANGE = (0.1, 3.0), (-4.0, -0.02)
#: Weight of tags that no labelled page has outside of side elements.
UNSEEN_TAG = -0.3

# HTML element names by role, and words in class, id and role attributes that mark what is not main text.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SIDE_TAGS = frozenset("nav footer aside form dialog menu button select option head svg math object canvas audio video label map".split())
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead topbar footer sidebar sidebars widget widgets comment comments commentlist disqus replies respond notice notices "
    "cookie cookies consent gdpr banner newsletter subscribe signup login search share sharing social related recommended recommendations "
    "popup modal overlay toolbar pagination pager copyright complementary contentinfo alert dialog header".split()
)
STORY_WORDS = frozenset("article entry post story content".split())
# Elements that an opening tag ends when they are still open, and those at which the search for them stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"})}
ENDS |= {"dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("table td th caption button object article section aside nav footer header main form div blockquote li".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORDS = re.compile(r"[a-z]+")


def _side_attributes(attributes: str, in_story: bool) -> bool:
    if not attributes:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            return True
        words = set(WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
        marks = words & SIDE_WORDS
        if marks == {"header"} and (in_story or words & STORY_WORDS):
            continue
        if marks:
            return True
    return False


@dataclass(slots=True)
class Part:
    """A tag or a stretch of text in page order."""

    kind: str  # tag name, or the name of the element that a text stands in
    text: str | None  # None for tags
    block: bool  # the tag starts or ends a block
    side: bool  # inside menus, adverts, comments and the like
    story: bool  # inside an article or main element


def parts_of(page: str) -> list[Part]:
    """Tags and texts of a page in one pass. Broken nesting is repaired as browsers do for the usual cases."""
    out: list[Part] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, side, story

    def inside() -> tuple[bool, bool]:
        return (open_tags[-1][1], open_tags[-1][2]) if open_tags else (False, False)

    def text(value: str) -> None:
        if value:
            side, story = inside()
            out.append(Part(open_tags[-1][0] if open_tags else "", entities.unescape(value), False, side, story))

    def close_to(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] in names:
                del open_tags[k:]
                return
            if open_tags[k][0] in stop:
                return

    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            text(page[at:])
            return out
        text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            if name in VOID or name in RAW:
                continue
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    _, side, story = open_tags[k]
                    del open_tags[k:]
                    out.append(Part(name, None, name in BLOCKS, side, story))
                    break
            else:
                out.append(Part(name, None, name in BLOCKS, *inside()))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            out.append(Part(name, None, False, *inside()))
            continue
        if name in ENDS:
            close_to(*ENDS[name])
        elif name in BLOCKS:
            close_to({"p"}, SCOPES)
        if name == "body":
            close_to({"head"}, frozenset())
        side, story = inside()
        side = side or name in SIDE_TAGS or (name == "header" and not story)
        side = side or (name not in ("html", "body", "article", "main") and _side_attributes(found[3], story))
        story = story or name in ("article", "main")
        out.append(Part(name, None, name in BLOCKS, side, story))
        if name not in VOID:
            open_tags.append((name, side, story))


@dataclass(frozen=True)
class Weights:
    """Scores of a word by the element it stands in (``word`` for others), of a tag by its name, and of a word outside the
    story if a page has one."""

    words: dict[str, float]
    tags: dict[str, float]
    word: float
    outside: float


def fit(pages: list[str]) -> Weights:
    """Log shares, inside against outside of the only article or main element of each labelled page, of words by element
    and of tags by name. Words are kept positive and tags negative. Side elements, which never count, do not teach."""
    counts: Counter = Counter()
    for page in pages:
        counts.update(counts_of(page))
    return weights_of(counts)


def counts_of(page: str) -> Counter:
    """Words and tags of a page outside of side elements, by (whether words, whether in the story, element)."""
    counts: Counter = Counter()
    for part in parts_of(page):
        if not part.side:
            is_word = part.text is not None
            counts[is_word, part.story, part.kind] += len(part.text.split()) if is_word else 1
    return counts


def weights_of(numbers: dict[tuple[bool, bool, str], int]) -> Weights:
    counts: dict[bool, dict[bool, Counter]] = {a: {b: Counter() for b in (True, False)} for a in (True, False)}
    for (is_word, story, kind), n in numbers.items():
        counts[is_word][story][kind] = n

    def ratios(is_word: bool, low: float, high: float) -> dict[str, float]:
        inner, outer = counts[is_word][True], counts[is_word][False]
        a, b = sum(inner.values()), sum(outer.values())
        share = {k: math.log((inner[k] + 0.5) / (a + 1)) - math.log((outer[k] + 0.5) / (b + 1)) for k in inner.keys() | outer.keys()}
        return {k: min(high, max(low, v)) for k, v in share.items()}

    words = ratios(True, *WORD_RANGE)
    word = sum(words.values()) / len(words) if words else sum(WORD_RANGE) / 2
    return Weights(words, ratios(False, *TAG_RANGE), word, -word)


def main_text(page: str, weights: Weights) -> str:
    """The best run of parts by score, found in one scan, as blocks of text. What stands in side elements scores nothing and is left out."""
    parts = [p for p in parts_of(page) if not p.side]
    has_story = any(p.story and p.text is not None and not p.text.isspace() for p in parts)
    best, best_run, total, first = 0.0, (0, 0), 0.0, 0
    for k, p in enumerate(parts):
        if p.text is None:
            total += weights.tags.get(p.kind, UNSEEN_TAG)
        elif has_story and not p.story:
            total += weights.outside * len(p.text.split())
        else:
            total += weights.words.get(p.kind, weights.word) * len(p.text.split())
        if total > best:
            best, best_run = total, (first, k + 1)
        if total <= 0:
            total, first = 0.0, k + 1
    blocks: list[list[str]] = [[]]
    for p in parts[best_run[0] : best_run[1]]:
        if p.text is not None:
            blocks[-1].append(p.text)
        elif p.block:
            blocks.append([])
        elif p.kind == "br":
            blocks[-1].append(" ")
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from about LABELLED_PAGES labelled pages (all, if there are fewer): those with the smallest hashes. Pages that
    repeat teach once. Pages are taken apart in tasks; only sums by element reach the driver."""
    once = F.size(F.split(F.lower(html), r"<(article|main)[\s>]")) == 2
    labelled = pages.where(once).select(F.xxhash64(html).alias("hash"), as_bytes(html).alias("html"))
    step = max(1, labelled.select("hash").distinct().count() // LABELLED_PAGES)
    some = labelled.where(F.col("hash") <= -(2**63) + 2**64 // step - 1)
    out = pa.schema([("hash", pa.int64()), ("is_word", pa.bool_()), ("story", pa.bool_()), ("kind", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for hashed, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if hashed not in seen:
                    seen.add(hashed)
                    found = counts_of(page.as_py().decode("utf-8", "replace"))
                    names = list(zip(*found, strict=True)) or [(), (), ()]
                    yield row_batch(out, [[hashed] * len(found), *names, list(found.values())])

    found = over_batches(some, count, "hash long, is_word boolean, story boolean, kind string, n long")
    found = found.groupBy("hash", "is_word", "story", "kind").agg(F.max("n").alias("n")).groupBy("is_word", "story", "kind").agg(F.sum("n").alias("n"))
    return weights_of({(r["is_word"], r["story"], r["kind"]): r["n"] for r in found.collect()})


def extract(pages: DataFrame, weights: Weights, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page. A null or empty page has an empty text, as has one without words outside
    of side elements. Pages that repeat come back as often as they came; other columns are left out."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py().decode("utf-8", "replace"), weights) for v in batch.column(2)]
            yield row_batch(out, [batch.column(0), batch.column(1), texts, [len(t) for t in texts]])

    return over_batches(pages.select("page_id", "url", as_bytes(html).alias("html")), work, "page_id long, url string, text string, n_chars long")


def op8_html(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return extract(pages, learn(pages))
