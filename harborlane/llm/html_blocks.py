"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page's leaf blocks are its stretches of text between block-level tags, in page order, each with the
elements around it. The field labels every block as main text or not from the tags and the words of
class, id and role of all elements around it, the nearest element whose name is listed, its parent and
depth, its text and links, and the text and links of the blocks before and after, together with the
labels of its neighbours; the best sequence is found by Viterbi decoding.

It is trained on pages whose markup says what is what: blocks inside ``article`` or ``main`` are main
text, unless a menu, header, footer, form, advert, notice or the like is nearer around them, or an
aside, menu, footer, comments, teasers or the like are anywhere around them below ``main``. Each page
teaches twice, the second time as if its elements had no names, so that parent, text, links and
neighbours have weights of their own for blocks with no listed element around them. Training starts from a
prior for the listed names, which also stands if no page can teach.
``max_pages`` bounds the pages trained on (the ones with the smallest hash); below it, all are.

Character references are decoded, white space within a block becomes one blank, blocks of main text
are joined by a line feed. Scripts, styles, comments and markup are no text, nor is what an element hides
(``hidden``, ``aria-hidden="true"``, ``display: none``, ``visibility: hidden``). Tags may be unclosed.
Null and empty pages, and pages without main text, have an empty text. Repeated pages are extracted
each. Pages are read whole. Extra columns may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborlane.llm.common import stored

MAX_PAGES = 2000
EPOCHS, RATE, DECAY, PRIOR = 6, 0.3, 1e-4, 3.0

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>""",
    re.S,
)
#: Elements whose content is text of another kind, up to their end tag.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "xmp"}
#: Elements of them that can hold more of themselves, and markup.
NESTED = {"svg", "template"}
#: Inside these elements of ``svg`` HTML may stand; elsewhere an element of HTML ends an open ``svg``.
HOLDS_HTML = {"foreignobject", "desc", "title"}
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li"
    " listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var".split()
)
#: An element that starts also ends an open one of these, if nothing of the second list is between.
CLOSES = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "option": ("option", "select"),
}
CONTENT_TAGS = {"article", "main"}
OTHER_TAGS = set(
    "nav header footer aside form dialog menu button select fieldset address head".split()
)
CONTENT_WORDS = {"article", "main", "content", "post", "entry", "story"}
OTHER_WORDS = set(
    "ad ads advert advertisement adverts alert author banner bar breadcrumb breadcrumbs byline"
    " comment comments complementary consent contentinfo cookie cookies copyright dialog disclaimer"
    " discussion disqus feedback footer form gdpr header hidden legal links login masthead menu meta modal nav navbar"
    " navigation newsletter notice notices notification pager pagination paging popup promo promoted"
    " recommended related replies reply respond search share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription tags teaser thread toolbar topbar tracking warning widget"
    .split()
)
#: What stays other text whatever is nested in it, but for ``main``, by family.
ASIDES = {
    name: family
    for family, names in {
        "aside": "aside complementary sidebar",
        "comments": "comment comments discussion disqus feedback replies reply respond thread",
        "menu": "breadcrumb breadcrumbs menu nav navbar navigation pagination",
        "footer": "footer contentinfo",
        "teaser": "promoted recommended related teaser",
        "advert": "ad ads advert advertisement adverts sponsored",
        "dialog": "dialog popup",
    }.items()
    for name in names.split()
}
#: The family of what is not shown, which nothing inside it can leave.
HIDDEN = "not shown"
#: A class that begins so tells what a page or post has or is about, not what the element is.
ABOUT = {"has", "with", "no", "without", "tag", "category", "is", "not"}
#: Containers of anything; their tags say nothing.
PLAIN = {"html", "body", "div", "section"}
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
HIDING = re.compile(
    r"""(?:^|\s)(?:aria-hidden\s*=\s*["']?true\b|style\s*=\s*(?:"[^"]*|'[^']*)"""
    r"""(?:display\s*:\s*none|visibility\s*:\s*hidden))""",
    re.I,
)
SPACE = re.compile(r"\s+")
CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def attribute_words(attributes: str) -> list[list[str]]:
    """The words of every name in ``class``, ``id`` and ``role``."""
    names = []
    for found in ATTRIBUTE.finditer(attributes):
        for name in (found[2] or found[3] or found[4] or "").split():
            words = [w for w in re.split(r"[^a-z]+", CAPITAL.sub(" ", name).lower()) if w]
            if words:
                names.append(words)
    return names


def hides(attributes: str) -> bool:
    """Whether an element with these attributes is not shown."""
    if HIDING.search(attributes):
        return True
    return "hidden" in QUOTED.sub("", attributes).lower().replace("=", " ").split()


def region(tag: str, names: list[list[str]]) -> tuple[str, str] | None:
    """(kind, name) if an element marks a region: its tag, else ``other`` words, else ``main`` ones."""
    if tag in CONTENT_TAGS:
        return "main", tag
    if tag in OTHER_TAGS:
        return "other", tag
    if tag in ("html", "body"):
        return None
    words = {w for own in names if own[0] not in ABOUT for w in own}
    if others := words & OTHER_WORDS:
        return "other", min(others, key=lambda w: (w not in ASIDES, w))
    if mains := words & CONTENT_WORDS:
        return "main", min(mains)
    return None


class Around:
    """What the elements around a block say: the nearest listed name and its kind, the family of text
    apart they lie in, and features of all of them."""

    __slots__ = ("kind", "marker", "family", "features")

    def __init__(self, kind="none", marker="none", family=None, features=("marker none",)):
        self.kind, self.marker, self.family, self.features = kind, marker, family, features

    def within(self, tag: str, attributes: str) -> Around:
        """The same with one more element inside."""
        names = attribute_words(attributes) if attributes else []
        own = [] if tag in PLAIN or tag in INLINE else [f"above {tag}"]
        if tag != "html" and tag != "body":
            own += [f"word {w}" for words in names for w in words]
        mark = region(tag, names)
        if not (own or mark or hides(attributes)):
            return self
        kind, marker, family = self.kind, self.marker, self.family
        if family == HIDDEN or hides(attributes):
            return Around("other", "hidden", HIDDEN, ("marker hidden",))
        if tag == "main":
            family = None
        if mark and not family:
            kind, marker = mark
            family = ASIDES.get(marker) if kind == "other" else None
        if self.family and family:
            # What a menu or a comment is made of is no evidence for main text.
            own = [f"{f} in {family}" for f in own]
        features = {f: None for f in self.features if not f.startswith(("marker ", "under "))}
        features[f"marker {marker}"] = None
        if family:
            features[f"under {family}"] = None
        features.update(dict.fromkeys(own))
        return Around(kind, marker, family, tuple(features))


class Block:
    """A leaf block: its text, what is around it, its parent and depth, how much of it is links."""

    __slots__ = ("text", "around", "parent", "depth", "linked")

    def __init__(self, text: str, around: Around, parent: str, depth: int, linked: int):
        self.text, self.around = text, around
        self.parent, self.depth, self.linked = parent, depth, linked

    def look(self) -> tuple[str, str]:
        words = self.text.count(" ") + 1
        return (
            f"words {min(int(math.log2(words)), 7)}",
            f"linked {4 * self.linked // max(len(self.text), 1)}",
        )

    def features(self) -> list[str]:
        return [
            "bias",
            f"parent {self.parent}",
            f"depth {min(int(math.log2(self.depth + 1)), 5)}",
            *self.look(),
            "sentence" if self.text[-1] in ".!?" else "open end",
            "copyright" if "©" in self.text else "no copyright",
        ]


def page_features(blocks: list[Block], marked: bool = True) -> list[list[str]]:
    """Features of each block of a page; without ``marked``, as if nothing listed were around it.

    Neighbours are judged by the region: links are no menu in an article. Where nothing listed is
    around, the features of text and neighbours are others, so that they weigh more.
    """
    looks = [(), *(b.look() for b in blocks), ()]
    found = []
    for i, b in enumerate(blocks):
        near = [*(f"before {f}" for f in looks[i]), *(f"after {f}" for f in looks[i + 2])]
        if marked and b.around.kind != "none":
            near = [f"{f} at {b.around.marker}" for f in near]
            found.append([*b.features(), *near, *b.around.features])
        else:
            bare = [f"bare {f}" for f in (*b.features(), *near)]
            found.append([*bare, *b.around.features] if marked else bare)
    return found


def raw_end(page: str, tag: str, attributes: str, at: int) -> int:
    """Where the raw element ends whose start tag ends at a place."""
    if tag == "svg" and attributes.endswith("/"):
        return at
    if tag not in NESTED:
        ending = re.compile(rf"</{tag}\s*/?>|</{tag}(?=[\s/])[^>]*>", re.I).search(page, at)
        return ending.end() if ending else len(page)
    opened = [tag]
    while found := TOKEN.search(page, at):
        inner, at = (found[2] or "").lower(), found.end()
        foreign = opened[-1] == "svg"
        if found[1]:
            for position in range(len(opened) - 1, -1, -1):
                if opened[position] == inner:
                    del opened[position:]
                    break
                if opened[position] == "template":
                    break
            if not opened:
                return at
        elif foreign and inner in BREAKS_OUT:
            while opened and opened[-1] == "svg":
                opened.pop()
            if not opened:
                return found.start()
        elif inner == "svg" or (foreign and inner in HOLDS_HTML):
            if not found[3].endswith("/"):
                opened.append(inner)
        elif not foreign and inner == "template":
            opened.append(inner)
        elif not foreign and inner in RAW:
            at = raw_end(page, inner, found[3], at)
    return len(page)


def leaf_blocks(page: str) -> list[Block]:
    stack: list[tuple[str, str, Around]] = []
    known: dict[tuple[int, str, str], Around] = {}
    outside = Around()
    parts: list[str] = []
    blocks: list[Block] = []
    linked = at = 0

    def end_block() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                outer = [t for t, _, _ in stack if t not in INLINE]
                around = stack[-1][2] if stack else outside
                parent = outer[-1] if outer else "none"
                blocks.append(Block(text, around, parent, len(outer), linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text:
            text = html.unescape(text)
            parts.append(text)
            if any(tag == "a" for tag, _, _ in stack):
                linked += len(text.strip())

    def close(position: int) -> None:
        end_block()
        del stack[position:]

    def open_element(tag: str, attributes: str) -> None:
        outer = stack[-1][2] if stack else outside
        key = (id(outer), tag, attributes)
        if key not in known:
            known[key] = outer.within(tag, attributes)
        stack.append((tag, attributes, known[key]))

    def innermost(tags, limits=()) -> int:
        for position in range(len(stack) - 1, -1, -1):
            if stack[position][0] in tags:
                return position
            if stack[position][0] in limits:
                break
        return -1

    while found := TOKEN.search(page, at):
        add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag in INLINE:
                position = innermost((tag,))
                if position >= 0:
                    above = stack[position + 1 :]
                    del stack[position:]
                    for inner, attributes, _ in above:
                        open_element(inner, attributes)
            else:
                end_block()
                position = innermost((tag,))
                if position >= 0:
                    del stack[position:]
            continue
        if tag == "br":
            parts.append(" ")
        elif tag in RAW:
            at = raw_end(page, tag, found[3], at)
        elif tag in VOID:
            if tag == "hr":
                end_block()
        elif tag in INLINE:
            open_element(tag, found[3])
        else:
            end_block()
            position = innermost(("p",), ("article", "main", "section", "div", "td", "li", "body"))
            if position >= 0:
                close(position)
            if tag in CLOSES:
                tags, limits = CLOSES[tag]
                position = innermost(tags.split(), limits.split())
                if position >= 0:
                    close(position)
            open_element(tag, found[3])
    add(page[at:])
    end_block()
    return blocks


class Field:
    """Weights of the field: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves=None):
        if weights is None:
            weights = {f"marker {name}": [-PRIOR, PRIOR] for name in CONTENT_TAGS | CONTENT_WORDS}
            weights |= {f"marker {name}": [PRIOR, -PRIOR] for name in OTHER_TAGS | OTHER_WORDS}
            weights |= {f"under {family}": [PRIOR, -PRIOR] for family in set(ASIDES.values())}
        self.weights = weights
        self.moves = np.zeros((2, 2)) if moves is None else np.array(moves)

    def scores(self, features: list[list[str]]) -> np.ndarray:
        none = [0.0, 0.0]
        return np.array(
            [np.sum([self.weights.get(f, none) for f in own], axis=0) for own in features]
        )

    def decode(self, features: list[list[str]]) -> list[int]:
        """The labels with the largest total score; equal scores go to main text."""
        moves = self.moves.tolist()
        weights, none = self.weights, (0.0, 0.0)
        value, back = None, []
        for own in features:
            here = [0.0, 0.0]
            for f in own:
                w = weights.get(f, none)
                here[0] += w[0]
                here[1] += w[1]
            if value is not None:
                steps = []
                for label in (0, 1):
                    from_0, from_1 = value[0] + moves[0][label], value[1] + moves[1][label]
                    steps.append(1 if from_1 >= from_0 else 0)
                    here[label] += max(from_0, from_1)
                back.append(steps)
            value = here
        if value is None:
            return []
        labels = [1 if value[1] >= value[0] else 0]
        for steps in reversed(back):
            labels.append(steps[labels[-1]])
        return labels[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]]) -> None:
        """Stochastic gradient ascent of the likelihood, with a rate per weight that falls."""
        squares: dict[str, np.ndarray] = {}
        move_squares = np.full((2, 2), 1e-8)
        weights = {f: np.array(w) for f, w in self.weights.items()}
        moves = self.moves
        for _ in range(EPOCHS):
            for features, labels in pages:
                zero = np.zeros(2)
                unary = np.array([sum((weights.get(f, zero) for f in own), zero) for own in features])
                single, double = marginals(unary, moves)
                gradient = -single
                gradient[np.arange(len(labels)), labels] += 1.0
                sums: dict[str, np.ndarray] = {}
                for own, g in zip(features, gradient):
                    for f in own:
                        sums[f] = sums[f] + g if f in sums else g
                for f, g in sums.items():
                    w = weights.get(f, zero)
                    g = g - DECAY * w
                    squares[f] = squares.get(f, 1e-8) + g * g
                    weights[f] = w + RATE * g / np.sqrt(squares[f])
                moved = -double
                np.add.at(moved, (labels[:-1], labels[1:]), 1.0)
                moved -= DECAY * moves
                move_squares += moved * moved
                moves = moves + RATE * moved / np.sqrt(move_squares)
        self.weights = {f: w.tolist() for f, w in weights.items()}
        self.moves = moves


def marginals(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities per block, and expected counts of neighbouring labels, by forward and
    backward sums; each step is scaled by its largest value."""
    step = np.exp(moves - moves.max())
    local = np.exp(unary - unary.max(axis=1, keepdims=True))
    ahead, behind = np.empty_like(local), np.ones_like(local)
    ahead[0] = local[0] / local[0].sum()
    for i in range(1, len(local)):
        ahead[i] = local[i] * (ahead[i - 1] @ step)
        ahead[i] /= ahead[i].sum()
    for i in range(len(local) - 2, -1, -1):
        behind[i] = step @ (local[i + 1] * behind[i + 1])
        behind[i] /= behind[i].sum()
    single = ahead * behind
    single /= single.sum(axis=1, keepdims=True)
    double = np.zeros((2, 2))
    for i in range(1, len(local)):
        pair = np.outer(ahead[i - 1], local[i] * behind[i]) * step
        double += pair / pair.sum()
    return single, double


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """Labels that the markup gives, or none if it does not say where the main text is."""
    if not any(b.around.kind == "main" and b.around.marker in CONTENT_TAGS for b in blocks):
        return None
    return [int(b.around.kind == "main") for b in blocks]


def train(pages: DataFrame, column: str = "html", max_pages: int = MAX_PAGES) -> Field:
    """A field trained in one task on at most about ``max_pages`` pages."""
    chance = min(1.0, max_pages / max(pages.count(), 1))
    sample = (
        pages.select(F.col(column).alias("html"))
        .where(F.col("html").isNotNull())
        .withColumn("key", F.xxhash64("html"))
        .where(F.pmod("key", F.lit(1 << 20)) < round(chance * (1 << 20)))
        # Copies of a page teach once.
        .groupBy("key")
        .agg(F.first("html").alias("html"))
        .withColumn("one", F.lit(1))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taught = []
        for batch in batches:
            for key, page in zip(batch["key"].to_pylist(), batch["html"]):
                blocks = leaf_blocks(page.as_py())
                labels = marked_labels(blocks)
                if labels:
                    taught += [(key, page_features(blocks, m), labels) for m in (True, False)]
        field = Field()
        field.train([page[1:] for page in sorted(taught, key=lambda page: page[0])])
        moves = [("", label, *field.moves[label].tolist()) for label in (0, 1)]
        rows = [(f, -1, *w) for f, w in field.weights.items()] + moves
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in zip(*rows)], ["feature", "move", "other", "main"]
        )

    rows = (
        stored(sample, "html-sample")
        .groupBy("one")
        .applyInArrow(run, "feature string, move bigint, other double, main double")
        .collect()
    )
    if not rows:
        return Field()
    return Field(
        {r["feature"]: [r["other"], r["main"]] for r in rows if r["move"] < 0},
        [[r["other"], r["main"]] for r in sorted(rows, key=lambda r: r["move"]) if r["move"] >= 0],
    )


def main_text(page: str | None, field: Field) -> str:
    blocks = leaf_blocks(page or "")
    labels = field.decode(page_features(blocks))
    return "\n".join(b.text for b, label in zip(blocks, labels) if label and b.around.family != HIDDEN)


def extract(pages: DataFrame, field: Field, column: str = "html") -> DataFrame:
    """(row, text): the whole input row as a struct, and the page's main text."""
    held = pages.sparkSession.sparkContext.broadcast((field.weights, field.moves.tolist()))
    row = pages.select(F.struct("*").alias("row"), F.col(column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*held.value)
        for batch in batches:
            for first in range(0, len(batch), 256):
                piece = batch.slice(first, 256)
                texts = [main_text(page.as_py(), own) for page in piece["html"]]
                yield pa.RecordBatch.from_arrays(
                    [piece["row"], pa.array(texts, pa.string())], ["row", "text"]
                )

    schema = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {schema}, text string")
