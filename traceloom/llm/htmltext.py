"""Main text of web pages by tag-path ratios.

A page is read as a sequence of blocks, each with its root-to-leaf path of block elements. Per path, the text length, the share of it
in links and the punctuation of all its blocks are added up and put per block. Along the page each block takes the mean of its
neighbours' path values (smoothing), the smoothed length and punctuation are fused into one value per path, scaled by the best path,
and paths at ``THRESHOLD`` or more are content. Being inside an article or main element adds ``PRIOR`` to a path's value and, on pages
that have one, being outside takes it away. Elements that hold no content by their tag, role, class or id are left out beforehand.

Null and empty html, and pages without content, give the empty text. Markup that is not closed or not open is read as browsers
do: a paragraph ends where the next block begins, a stray end tag ends nothing. Repeated rows are read each.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.batches import slices, texts

THRESHOLD = 0.3
PRIOR = 0.5
KERNEL = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
EXTRACTED = "page_id long, url string, text string, n_chars long"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^'\">]++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>",
    re.S,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|\baria-hidden\s*=\s*["']?true""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…¿¡。，、；：！？]")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
# What a start tag closes, and the elements beyond which it does not look.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol menu dl table tbody thead tfoot tr select div section article body".split())
NO_CONTENT = frozenset(
    "head script style noscript template svg canvas iframe object nav footer aside form button select textarea dialog menu".split()
)
CONTENT = frozenset(("article", "main"))
NO_CONTENT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NO_CONTENT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay comment comments reply replies respond disqus "
    "share sharing social related recommended newsletter subscribe subscription signup login search widget toolbar pagination skip".split()
)


def holds_no_content(tag: str, attributes: str, in_content: bool) -> bool:
    """Whether an element is left out with all it holds."""
    if tag in NO_CONTENT or (tag == "header" and not in_content):
        return True
    if not attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for m in NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        names = set(re.split(r"[^a-z0-9]+", value))
        if names & (NO_CONTENT_ROLES if m[1].lower() == "role" else NO_CONTENT_NAMES):
            return True
    return False


class Block:
    """A block's text so far, its path and whether it lies in an article or main element."""

    __slots__ = ("path", "inside", "parts", "linked")

    def __init__(self, path: tuple[str, ...], inside: bool):
        self.path, self.inside, self.parts, self.linked = path, inside, [], 0


def blocks_of(page: str) -> list[tuple[str, tuple[str, ...], bool, float]]:
    """The blocks outside left-out elements in page order: text, path, inside an article or main element, share of text in links."""
    stack: list[tuple[str, bool, bool]] = []  # tag, left out, inside
    out: list[Block] = []
    fresh, raw, at, links = True, None, 0, 0

    def add(text: str) -> None:
        nonlocal fresh
        left_out, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if left_out or not text:
            return
        if fresh:
            if not text.strip():
                return
            out.append(Block(tuple(t for t, _, _ in stack if t in BLOCK), inside))
            fresh = False
        text = html.unescape(text) if "&" in text else text
        out[-1].parts.append(text)
        if links:
            out[-1].linked += len(text)

    def close(depth: int) -> None:
        nonlocal fresh, links
        for tag, _, _ in stack[depth:]:
            fresh = fresh or tag in BLOCK
            links -= tag == "a"
        del stack[depth:]

    for m in TOKEN.finditer(page):
        tag = (m[2] or m[5] or "").lower()
        ending = bool(m[1] or m[4])
        if raw and not (ending and tag == raw):
            continue
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        if not tag:
            continue
        if ending:
            raw = None
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if depth >= 0:
                close(depth)
            elif tag == "p":
                fresh = True
            continue
        if tag in BLOCK:
            fresh = True
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), -1)
            if depth >= 0:
                close(depth)
        if tag in CLOSES:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if tag in VOID:
            if tag == "br":
                add(" ")
            continue
        attributes = m[3] if m[2] else m[6]
        left_out, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        inside = inside or tag in CONTENT
        stack.append((tag, left_out or holds_no_content(tag, attributes, inside), inside))
        links += tag == "a"
        if tag in RAW:
            raw = tag
    if raw is None:
        add(page[at:])
    found = []
    for block in out:
        whole = "".join(block.parts)
        text = SPACE.sub(" ", whole).strip()
        if text:
            found.append((text, block.path, block.inside, min(1.0, block.linked / len(whole))))
    return found


def content_paths(blocks: list[tuple[str, tuple[str, ...], bool, float]]) -> dict[tuple[tuple[str, ...], bool], float]:
    """The fused value of each (path, inside) of a page."""
    keys = [(path, inside) for _, path, inside, _ in blocks]
    names = {key: k for k, key in enumerate(dict.fromkeys(keys))}
    of_block = np.array([names[key] for key in keys])
    number = np.bincount(of_block)
    lengths = np.bincount(of_block, [len(t) * (1 - share) for t, _, _, share in blocks]) / number
    marks = np.bincount(of_block, [len(PUNCTUATION.findall(t)) * (1 - share) for t, _, _, share in blocks]) / number
    weight = np.convolve(np.ones(len(blocks)), KERNEL, "full")[2:-2]
    smooth = [np.convolve(values[of_block], KERNEL, "full")[2:-2] / weight for values in (np.log1p(lengths), np.log1p(marks))]
    fused = np.bincount(of_block, smooth[0] * (1 + smooth[1])) / number
    fused = fused / fused.max() if fused.max() > 0 else fused
    any_inside = any(inside for _, inside in names)
    return {key: fused[k] + (PRIOR if key[1] else -PRIOR if any_inside else 0.0) for key, k in names.items()}


def main_text(page: str) -> str:
    """The content blocks of a page, joined by empty lines."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    values = content_paths(blocks)
    return "\n\n".join(text for text, path, inside, _ in blocks if values[path, inside] >= THRESHOLD)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(t) for t in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, EXTRACTED)
