"""Main text of web pages: flat text blocks judged by a small decision tree."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements of the HTML vocabulary, by role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
UNSEEN = frozenset("script style noscript template textarea select button iframe object svg math canvas title".split())
CODE = frozenset("script style".split())  # without an end tag these run to the end of the page
DRAWN = frozenset("svg math".split())  # a slash at the end of the start tag closes these
CONTAINERS = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split()
)
CHROME = frozenset("nav footer form menu dialog".split())
ASIDE = frozenset(["aside"])
HINT = re.compile(
    r"(?i)(?:^|[\s_-])(?:(comments?|replies|discussion|sidebar|related|respond)|"
    r"(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|nav\w*|menu|"
    r"breadcrumbs?|foot\w*|masthead|share|social|login|signup|search|toolbar|pagination))(?:$|[\s_-])"
)
NOTICE = re.compile(
    r"(?i)©|copyright (?:\d|\(c\))|all rights reserved|\b(?:we|sites?|uses?|using|accept|our|these|all) (?:\w+ )?cookies\b|"
    r"\bcookies? (?:policy|settings|notice|consent|preferences|banner)|\bsubscribe (?:to|now|for|today)\b|\bour newsletter|^(?:sign|log) in\b|^advertisement"
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in UNSEEN}
_NAMED = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "role", "inside", "page_has_main", "notice")
# Labelled blocks: the features above (links: share of words inside links; role: 1 page furniture,
# 2 comments and asides; inside: 1 in article or main), then 1 for main text.
LABELLED = (
    (5, 1.0, 0, 0.0, 5, 1.0, 1, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0, 0), (9, 0.0, 1, 1.0, 11, 0.0, 1, 0, 1, 0, 0),
    (40, 0.0, 2, 1.0, 60, 0.0, 1, 0, 1, 0, 0), (14, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1, 1, 0), (3, 0.0, 50, 0.0, 0, 0.0, 1, 0, 1, 1, 0),
    (60, 0.0, 20, 0.0, 40, 0.0, 1, 1, 1, 0, 0), (12, 0.0, 90, 0.0, 30, 0.0, 1, 1, 1, 1, 0), (6, 1.0, 6, 1.0, 6, 1.0, 1, 1, 1, 0, 0),
    (40, 0.0, 70, 0.0, 35, 0.0, 2, 0, 1, 0, 0), (3, 0.0, 70, 0.0, 40, 0.0, 2, 1, 1, 0, 0), (80, 0.0, 60, 0.0, 10, 0.0, 2, 1, 1, 0, 0),
    (25, 0.1, 4, 1.0, 25, 0.1, 2, 0, 0, 0, 0), (70, 0.0, 5, 0.0, 60, 0.0, 2, 0, 0, 0, 0), (4, 0.5, 3, 0.0, 70, 0.0, 2, 0, 0, 0, 0),
    (11, 0.0, 9, 0.0, 70, 0.0, 0, 1, 1, 0, 1), (80, 0.0, 11, 0.0, 30, 0.0, 0, 1, 1, 0, 1), (1, 0.0, 50, 0.0, 60, 0.0, 0, 1, 1, 0, 1),
    (2, 0.0, 3, 0.0, 4, 0.0, 0, 1, 1, 0, 1), (30, 0.3, 60, 0.0, 12, 0.0, 0, 1, 1, 0, 1), (90, 0.1, 60, 0.0, 14, 0.0, 0, 1, 1, 1, 1),
    (6, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1, 0, 1), (22, 0.0, 10, 0.0, 1, 0.0, 0, 1, 1, 1, 1), (12, 0.4, 90, 0.0, 40, 0.0, 0, 1, 1, 0, 1),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 1, 1, 0, 0), (5, 0.9, 60, 0.0, 5, 1.0, 0, 1, 1, 0, 0), (8, 1.0, 5, 1.0, 20, 0.0, 0, 1, 1, 0, 0),
    (20, 0.0, 1, 1.0, 11, 0.0, 0, 0, 1, 0, 0), (9, 0.0, 5, 1.0, 80, 0.0, 0, 0, 1, 0, 0), (30, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1, 1, 0),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 1, 0, 0), (55, 0.0, 6, 0.0, 12, 0.0, 0, 0, 1, 0, 0),
    (70, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 0, 1), (45, 0.1, 60, 0.0, 2, 1.0, 0, 0, 0, 0, 1), (120, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (20, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 1), (8, 0.0, 2, 1.0, 70, 0.0, 0, 0, 0, 0, 1), (4, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 1),
    (16, 0.2, 50, 0.0, 3, 0.0, 0, 0, 0, 0, 1), (7, 0.0, 90, 0.0, 30, 0.0, 0, 0, 0, 0, 1),
    (3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0, 0, 0), (12, 0.9, 20, 0.0, 9, 1.0, 0, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 1, 0), (9, 0.2, 40, 0.0, 0, 0.0, 0, 0, 0, 1, 0),
    (14, 0.0, 0, 0.0, 5, 1.0, 0, 0, 0, 1, 0), (25, 0.1, 50, 0.0, 3, 0.0, 0, 0, 0, 1, 0),
)


@dataclass(frozen=True)
class Node:
    """A split (feature, limit: at most goes left) or, with feature -1, a leaf with a label."""

    feature: int
    limit: float
    left: "Node | None"
    right: "Node | None"
    label: bool

    def judge(self, row) -> bool:
        node = self
        while node.feature >= 0:
            node = node.left if row[node.feature] <= node.limit else node.right
        return node.label


def grow_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 7) -> Node:
    """A classification tree by Gini impurity; the first feature and lowest limit win ties, a leaf's tie is main text."""
    leaf = Node(-1, 0.0, None, None, bool(2 * labels.sum() >= len(labels)))
    if not depth or labels.min() == labels.max():
        return leaf
    best = (len(labels) * 2.0, -1, 0.0)
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            left = rows[:, f] <= limit
            cost = sum(2 * p.sum() * (len(p) - p.sum()) / len(p) for p in (labels[left], labels[~left]))
            if cost < best[0] - 1e-9:
                best = (cost, f, float(limit))
    if best[1] < 0:
        return leaf
    left = rows[:, best[1]] <= best[2]
    return Node(best[1], best[2], grow_tree(rows[left], labels[left], depth - 1), grow_tree(rows[~left], labels[~left], depth - 1), leaf.label)


def trained_tree(labelled=LABELLED) -> Node:
    table = np.array(labelled, float)
    return grow_tree(table[:, :-1], table[:, -1].astype(int))


def _role(name: str, attrs: str, inside: int) -> int:
    """Role that an element gives to what it holds. The names of body and main, and of an article that is in
    no other, say what kind of page it is, not that its text is furniture."""
    if name in ASIDE:
        return 2
    if name in CHROME or (name == "header" and not inside):
        return 1
    if name in ("body", "main") or (name == "article" and not inside):
        return 0
    found = 0
    for value in _NAMED.findall(attrs) if attrs else ():
        hint = HINT.search("".join(value))
        if hint:
            found = max(found, 2 if hint[1] else 1)
    return found


def _past(page: str, name: str, attrs: str, at: int, open_ended: set[str]) -> int:
    """Where reading goes on after the start tag, which ends at `at`, of an element that is never text.

    open_ended: names with no end tag from here on, so that each is sought in vain once a page.
    """
    if name in DRAWN and attrs.endswith("/"):
        return at
    end = None if name in open_ended else _END[name].search(page, at)
    if end:
        return end.end()
    open_ended.add(name)
    return len(page) if name in CODE else at


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, share of words in links, role, inside) of the page's text blocks, in order.

    An element that is called page furniture, but holds most of the words that are not links, is the
    page's frame: its name counts for nothing.

    Elements that are never text are skipped with their content, or the tag alone where the end tag
    is missing (script and style run to the end of the page, as in browsers). A head is no more than
    its elements, so one without an end tag hides nothing after them. Otherwise a missing end tag ends
    with the element around it, and an article ends unclosed page furniture before it.
    """
    out, parts, stack = [], [], []  # stack: (name, role, inside, the outermost element that is furniture by its name)
    role = inside = in_link = link_words = frame = frames = 0
    framed: dict[int, float] = {}

    def close() -> None:
        nonlocal link_words
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            share = min(1.0, link_words / n)
            out.append((text, n, share, role, inside, frame))
            framed[frame] = framed.get(frame, 0.0) + n * (1 - share)
        parts.clear()
        link_words = 0

    def add(raw: str) -> None:
        nonlocal link_words
        text = entities.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            link_words += len(text.split())

    at, open_ended = 0, set()
    while tag := _TAG.search(page, at):
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        name = name.lower()
        if name in UNSEEN and not tag["end"]:
            close()
            at = _past(page, name, tag["attrs"], at, open_ended)
            continue
        if name in INLINE:
            if name == "a":
                in_link = 0 if tag["end"] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        close()
        in_link = 0
        if name not in CONTAINERS:
            continue
        if tag["end"]:
            if any(name == open_[0] for open_ in stack):
                while stack.pop()[0] != name:
                    pass
        else:
            own = _role(name, tag["attrs"], inside)
            if name in ("article", "main"):
                kind = 0 if name == "main" else max(own, 2 if role == 2 else 0)
                stack.append((name, kind, 1, 0))
            else:
                if own == 1 and not role and name not in CHROME and name != "header":
                    frames += 1
                    frame = frames
                stack.append((name, max(role, own), inside, frame))
        role, inside, frame = stack[-1][1:] if stack else (0, 0, 0)
    if at < len(page):
        add(page[at:])
    close()
    whole = sum(framed.values())
    return [(*b[:3], 0 if b[3] == 1 and b[5] and 2 * framed[b[5]] > whole else b[3], b[4]) for b in out]


def main_text(page: str | None, tree: Node) -> tuple[str, int, int]:
    """(main text, blocks of the page, blocks kept)."""
    found = blocks(page or "")
    has_main = int(any(b[4] and not b[3] for b in found))
    kept = []
    for i, (text, words, links, role, inside) in enumerate(found):
        before = found[i - 1][1:3] if i else (0, 0.0)
        after = found[i + 1][1:3] if i + 1 < len(found) else (0, 0.0)
        notice = int(bool(NOTICE.search(text)))
        if tree.judge((words, links, *before, *after, role, inside, has_main, notice)):
            kept.append(text)
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """One row per row of pages: the key columns, text, n_chars, n_blocks, n_kept.

    A null or empty page, and one without main text, gives the empty string and 0. Pages are read
    whole, one at a time inside a task: nothing is shuffled. Keys may be null or repeat; other
    columns are ignored.
    """
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [main_text(page.as_py(), tree) for page in batch.column(len(keys))]
            texts = [r[0] for r in rows]
            columns = [
                *batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "text", "n_chars", "n_blocks", "n_kept"])

    kinds = "".join(f"`{k}` {pages.schema[k].dataType.simpleString()}, " for k in keys)
    return pages.select(*keys, html_col).mapInArrow(run, kinds + "text string, n_chars long, n_blocks long, n_kept long")
