"""HTML extraction by tag-path ratios: a page's main text, without menus, adverts and other frames.

Each text block hangs at a root-to-leaf path of tags.  Per path, the length of text, its punctuation, the text
within links and the number of tags are added up; the text-to-tag ratio of the paths is smoothed with that of
their neighbours in page order, fused with the punctuation ratio and the share of text outside links, and paths
over a threshold that the page itself sets are content.  Names and tags are a feature of the score: where a page has
an article (or main) element, paths outside it weigh less, as do those in a frame (nav, footer, form, comments, and
so on, by tag, role, class or id); headings, paragraphs, list items and cells weigh more, and so does a path within the
article that has a block beside one of a content path.  An element that holds an article, or on a page without one
most of the text in several blocks, is no frame whatever its name.  Hidden elements are never content.

Defined results: a null or empty page, or one without content, gives an empty text; unclosed, misnested and cut
off mark-up is read as far as it goes; repeated rows and null ids are pages of their own; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_SPACE = re.compile(r"\s+")
_ATTRIBUTES = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg iframe object select".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
FRAME = frozenset("nav header footer aside form button menu dialog head".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
FRAME_NAMES = re.compile(r"(?:^|(?<=[\s_-]))(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|newsletter|subscribe|popup|modal|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|header|comments?|replies|reply|disqus|related|share|sharing|social|pagination|widget)(?=$|[\s_-])", re.IGNORECASE)
#: Weights of paths in frames, of those outside the article where there is one, and elsewhere of tags that hold text.
IN_FRAME, OUTSIDE = 0.01, 0.05
#: Score, of the best, of a path within the article that has a block next to one of a content path.
BESIDE = 0.2
TAGS = dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), 8.0) | dict.fromkeys("p li td th dd dt blockquote pre figcaption caption summary".split(), 4.0)
#: Characters a tag, and share of punctuation, beyond which more is no more evidence (a page of long paragraphs keeps its headline).
LONG, DENSE = 200, 0.1
PUNCTUATION = re.compile(r"[.,;:!?。，、]")
#: Elements that end an open one of their kind, within the nearest of the others.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


class Blocks:
    """Text blocks of a page in order, each with its path, whether a frame holds it, and counts."""

    def __init__(self, page: str):
        self.out: list[dict] = []
        self.stack: list[tuple[str, int]] = []  # tag, and the number of the frame that it begins (0: none, -1: hidden)
        self.within: Counter = Counter()  # how many elements of each tag are open
        self.frames = 0
        self.named: dict[int, bool] = {}  # of each frame, whether a form or a name makes it one, rather than its tag
        self.holders: set[int] = set()  # frames that hold an article
        self.text: list[str] = []
        self.linked, self.tags = 0, 0
        self.read(page)
        self.articles = any(b["article"] for b in self.out)
        if not self.articles:
            sizes: Counter = Counter()
            blocks = Counter(f for b in self.out for f in b["frames"])
            for b in self.out:
                sizes.update(dict.fromkeys(b["frames"], len(b["text"]) - b["linked"]))
            total = sum(len(b["text"]) - b["linked"] for b in self.out)
            self.holders |= {f for f, n in sizes.items() if 2 * n > total and blocks[f] > 1 and self.named[f]}
        for b in self.out:
            b["frame"] = bool(b["frames"] - self.holders)

    def end_block(self) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.text))).strip()
        if text and not any(f < 0 for _, f in self.stack):
            tags = [t for t, _ in self.stack if t in BLOCK]
            self.out.append({
                "path": "/".join(tags), "text": text, "frames": frozenset(f for _, f in self.stack if f), "tags": self.tags + 1, "linked": min(self.linked, len(text)),
                "article": any(t in ("article", "main") for t in tags), "punctuation": len(PUNCTUATION.findall(text)),
            })
        self.text, self.linked, self.tags = [], 0, 0

    def close(self, tag: str) -> None:
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        if any(t in BLOCK for t, _ in self.stack[at:]):
            self.end_block()
        self.drop(at)

    def drop(self, at: int) -> None:
        """Takes open elements off the stack."""
        self.within.subtract(t for t, _ in self.stack[at:])
        del self.stack[at:]

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end_block()
            if tag in CLOSES or self.within["p"]:
                for i in range(len(self.stack) - 1, -1, -1):
                    own = self.stack[i][0]
                    if own in ("table", "ul", "ol", "dl", "article", "main", "section", "div", "body", "blockquote", "nav", "aside", "footer", "header", "form"):
                        break
                    if tag in CLOSES.get(own, ()):
                        self.drop(i)
                        break
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTES.findall(attributes)} if attributes and not attributes.isspace() else {}
        # A header within the article holds its headline.
        frame = tag in FRAME and not (tag == "header" and self.within["article"])
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        names = {n.strip(" _-").lower() for k in ("class", "id") for n in FRAME_NAMES.findall(found.get(k, ""))} if tag not in ("html", "body", "article", "main") else set()
        named = found.get("role", "").lower() in FRAME_ROLES or bool(names - ({"header"} if self.within["article"] else set()))
        if frame or named:
            self.frames += 1
            self.named[self.frames] = named or tag == "form"
        self.within[tag] += 1
        self.stack.append((tag, -1 if hidden else self.frames if frame or named else 0))
        if tag in ("article", "main") and not hidden:
            self.holders |= {f for _, f in self.stack[:-1] if f > 0}

    def read(self, page: str) -> None:
        at, end = 0, len(page)
        while at < end:
            m = _TAG.search(page, at)
            words = page[at : m.start() if m else end]
            if words:
                self.text.append(words)
                if self.within["a"]:
                    self.linked += len(words)
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.tags += 1
                self.close(tag)
            elif tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}[^>]*(?:>|\\Z)", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
            elif tag in VOID:
                self.tags += 1
                if tag == "hr":
                    self.end_block()
                elif tag in ("br", "wbr"):
                    self.text.append(" " if tag == "br" else "")
            else:
                self.tags += 1
                if not m[3].endswith("/"):
                    self.open(tag, m[3])
        self.end_block()


def main_text(page: str, share: float = 0.1) -> str:
    """The text of the content paths' blocks, joined by empty lines.  share: threshold, of the best path's score."""
    seen = Blocks(page)
    paths: dict[tuple[str, bool], list[float]] = {}
    for b in seen.out:
        own = paths.setdefault((b["path"], b["frame"]), [0, 0, 0, 0])
        for i, x in enumerate((len(b["text"]), b["tags"], b["punctuation"], b["linked"])):
            own[i] += x
    best, score = 0.0, {}
    near: dict[tuple[bool, bool], list[tuple[str, bool]]] = {}  # neighbours are of one kind: a frame doesn't lift the text beside it
    inside = {(b["path"], b["frame"]): b["article"] for b in seen.out}
    for k in paths:
        near.setdefault((k[1], inside[k]), []).append(k)
    for (frame, article), keys in near.items():
        ratio = [min(LONG, paths[k][0] / paths[k][1]) for k in keys]
        weight = (IN_FRAME if frame else 1) * (OUTSIDE if seen.articles and not article else 1)
        for i, k in enumerate(keys):
            n, _, p, a = paths[k]
            smooth = sum(r := ratio[max(0, i - 1) : i + 2]) / len(r)
            own = weight * math.sqrt(ratio[i] * smooth) * (1 + min(DENSE, p / n) * 20) * (1 - a / n)
            best = best if frame else max(best, own)
            score[k] = own * (TAGS.get(k[0].rsplit("/", 1)[-1], 1) if weight == 1 else 1)
    # What lies within the article beside its content is content: a short line, a list of sources; but no box that is mostly link.
    own = [b for b in seen.out if b["article"] and not b["frame"]]
    beside = {(x["path"], False) for a, b in pairwise(own) for x, y in ((a, b), (b, a)) if score[y["path"], False] > share * best}
    for k in beside:
        if 2 * paths[k][3] <= paths[k][0] or k[0].rsplit("/", 1)[-1] in TAGS:
            score[k] = max(score[k], BESIDE * best)
    return "\n\n".join(b["text"] for b in seen.out if best and score[b["path"], b["frame"]] > share * best)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text of its main content, and n_chars."""
    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
