"""HTML extraction with wrappers inferred as union-free regular expressions.

A page becomes a stream of structural tags and texts; runs that repeat side by side are folded into repeated groups. The
pages of a host are aligned one after the other with the wrapper so far (longest common subsequence of items): different
texts at the same place become a slot, an item that one side lacks becomes an optional group, and a single copy of a group
that the other side repeats becomes that repeated group. There are no unions. Every text of the wrapper, constant or slot,
carries how many texts it stands for, their characters and the characters of links among them. Partial wrappers of salted
parts of a host are aligned with each other in the same way, so a host with a third of all pages is no one task's burden.
Pages without any text say nothing about a template and are left out; wrappers of any length are kept, long ones are
aligned in pieces.

The wrapper says where a host keeps its article: from the whole page down, the element that holds nearly all characters of
slots and repeated groups that are no link lists; an element that the tags or class names mark as menu, notice, advert,
form and the like is never taken. A page is aligned with its host's wrapper, and its text are the blocks at slots and
groups inside that element; where it is no article or main element, without groups of links and without what is constant
over three pages or more (unless nearly all is constant, as on a host of copies). A page that has no text there is read by
its own expression alone.

Defined results: null and empty html give empty text; a null url has the empty host, which is a host like others; repeated
rows are pages of their own; an empty table gives an empty result; extra columns are ignored. Unclosed and stray tags are
tolerated; hidden elements are no text.
"""

from __future__ import annotations

import html as entities
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, url_rules

OPENS = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRS = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
RAW = frozenset("script style noscript template textarea svg math iframe object select title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("nav footer aside form button menu dialog input option fieldset".split())
#: Elements that hold running text and are never the whole article.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figcaption caption address summary".split())
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor(?:ed|s|ship)?|promos?|promotion|banner|sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|comments?|commentlist|disqus|skip-link)(?:$|[\s_-])", re.I)
ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|alert|dialog|form)\b", re.I)
MARK = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|\bstyle\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
SPACE = re.compile(r"\s+")
#: Cells of the table that two wrappers are aligned by at once.
CELLS = 1 << 22
#: Share of the characters that the article's element holds.
MOST = 0.8


# -- pages ------------------------------------------------------------------------------------------


def noisy(attrs: str) -> bool:
    if not attrs:
        return False
    return ROLE.search(attrs) is not None or any(NOISE.search(a or b or c) for a, b, c in MARK.findall(attrs)) or HIDDEN.search(QUOTED.sub("", attrs)) is not None or HIDDEN.search(attrs) is not None and "style" in attrs.lower()


def blocks(html: str | None) -> list[tuple[tuple[str, ...], str, int, tuple[int, ...]]]:
    """(path of open elements, text, characters of links, numbers of the open elements) of every text block, in page order.
    A path element is a tag, with + for the noisy ones."""
    html = html or ""
    out: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []
    stack: list[str] = []
    number: list[int] = []  # of each open element
    opened = 0
    text: list[str] = []
    links: list[str] = []
    at, n, last = 0, len(html), html.rfind(">")
    within_link = False
    skipped: list[str] = []  # open inline elements inside a noisy one

    def add(s: str) -> None:
        if s and not skipped:
            text.append(s)
            if within_link:
                links.append(s)

    def flush() -> None:
        if text:
            s = SPACE.sub(" ", "".join(text)).strip()
            if s:
                out.append((tuple(stack), s, min(len(s), len(SPACE.sub(" ", "".join(links)).strip())), tuple(number[: len(stack)])))
            text.clear()
            links.clear()

    while at < n:
        m = OPENS.search(html, at)
        if m is None:
            add(entities.unescape(html[at:]))
            break
        if m.start() > at:
            add(entities.unescape(html[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            kind = m[0]
            if kind == "<!--":
                end = html.find("-->", at)
                at = end + 3 if end >= 0 else n
            elif kind == "<![CDATA[":
                end = html.find("]]>", at)
                add(html[at : end if end >= 0 else n])
                at = end + 3 if end >= 0 else n
            else:
                end = html.find(">", at)
                at = end + 1 if end >= 0 else n
            continue
        if at > last:  # no tag ends behind this place
            break
        a = ATTRS.match(html, at)
        end = a.end() if a else html.find(">", at) + 1
        attrs, at = html[at : end - 1], end
        name, closing = name.lower(), bool(m[1])
        if not closing and name in RAW and not attrs.rstrip().endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            if name not in ("svg", "math"):
                flush()
            continue
        if name in INLINE:
            if name == "br":
                add(" ")
            elif name not in VOID:
                if skipped:
                    if closing and name in skipped:
                        while skipped.pop() != name:
                            pass
                    elif not closing:
                        skipped.append(name)
                elif not closing and noisy(attrs):
                    skipped.append(name)
                if name == "a":
                    within_link = not closing
            continue
        flush()
        skipped.clear()
        within_link = False
        if closing:
            if name in stack or f"{name}+" in stack:
                while stack and stack[-1].rstrip("+") != name:
                    stack.pop()
                stack.pop()
            continue
        if name in ENDS_P and stack and stack[-1].rstrip("+") == "p":
            stack.pop()
        if name == "li" and stack and stack[-1].rstrip("+") == "li":
            stack.pop()
        if name in VOID:
            continue
        del number[len(stack) :]
        stack.append(name + "+" * noisy(attrs))
        number.append(opened)
        opened += 1
    flush()
    return out


def text_key(s: str) -> str:
    return f"{common.Words([s]).hash.sum(dtype='uint64') & 0xFFFFFFFF:x}"


# -- streams and wrappers: a tag is a string, a text is '=key~texts~characters~links' or '#~...', a group is (kind, body) ----


def shape(item) -> object:
    """What items are aligned by: texts are alike, and a repeated or optional group is like its body."""
    if isinstance(item, str):
        return "#" if item[0] in "=#" else item
    if item[0] == "#":
        return "#"
    return shape(item[1][0]) if len(item[1]) == 1 else tuple(shape(x) for x in item[1])


def joined(a, b):
    """Two copies of a group's part as one: leaves ('#', text numbers) are put together."""
    if isinstance(a, str):
        return a
    return ("#", a[1] + b[1]) if a[0] == "#" else (a[0], tuple(joined(x, y) for x, y in zip(a[1], b[1], strict=True)))


def balanced(body: list) -> bool:
    """Whether the tags of a group's body nest."""
    stack: list[str] = []
    for x in body:
        if isinstance(x, str) and x[0] not in "=#":
            if x[0] != "/":
                stack.append(x)
            elif not stack or stack.pop() != x[1:]:
                return False
    return not stack


def _widths(keys: list):
    """The widths at which some group of keys is followed by its like, in order."""
    code: dict = {}
    x = np.array([code.setdefault(k, len(code)) for k in keys], np.int32)
    for width in range(1, len(x) // 2 + 1):
        unlike = np.flatnonzero(x[:-width] != x[width:])
        if np.diff(unlike, prepend=-1, append=len(x) - width).max() > width:
            yield width


def fold(items: list) -> list:
    """Fold runs of a group of any width repeated side by side, shortest groups first, until nothing folds."""
    changed = True
    while changed:
        changed = False
        keys = [shape(x) for x in items]
        for width in _widths(keys):
            i, out = 0, []
            while i < len(items):
                reps = 1
                body = keys[i : i + width]
                while len(body) == width and body == keys[i + reps * width : i + (reps + 1) * width]:
                    reps += 1
                if reps > 1 and balanced(items[i : i + width]):
                    one = items[i : i + width]
                    for r in range(1, reps):
                        one = [joined(x, y) for x, y in zip(one, items[i + r * width : i + (r + 1) * width], strict=True)]
                    out.append(one[0] if width == 1 and one[0][0] == "+" else ("+", tuple(one)))
                    i += reps * width
                else:
                    out.append(items[i])
                    i += 1
            if len(out) < len(items):
                items, changed = out, True
                break
    return items


_folded: dict[tuple, list] = {}


def folded(found: list) -> list:
    """The folded stream of a page's blocks, with ('#', numbers) for texts; pages of one structure are folded once."""
    out: list = []
    path: tuple[str, ...] = ()
    open_: tuple[int, ...] = ()
    for number, (p, _, _, ids) in enumerate(found):
        k = 0
        while k < min(len(ids), len(open_)) and ids[k] == open_[k]:
            k += 1
        out += [f"/{t}" for t in reversed(path[k:])] + list(p[k:]) + [("#", (number,))]
        path, open_ = p, ids
    out += [f"/{t}" for t in reversed(path)]
    key = tuple(x if isinstance(x, str) else None for x in out)
    if key not in _folded:
        if len(_folded) > 4096:
            _folded.clear()
        _folded[key] = fold(out)
    return _folded[key]


def stream_of(found: list) -> list:
    """The page as a wrapper of its own."""

    def fill(x, single: bool):
        if isinstance(x, str):
            return x
        if x[0] != "#":
            return (x[0], tuple(fill(y, False) for y in x[1]))
        mine = [found[k] for k in x[1]]
        return f"{'=' + text_key(mine[0][1]) if single else '#'}~{len(mine)}~{sum(len(x[1]) for x in mine)}~{sum(x[2] for x in mine)}"

    return [fill(x, True) for x in folded(found)]


def stream(html: str | None) -> list:
    return stream_of(blocks(html))


def unify(a, b):
    """One item that fits all that a or b fit; both have the same shape."""
    if isinstance(a, str) and isinstance(b, str):
        if a[0] not in "=#":
            return a
        (key, *x), (other, *y) = a.split("~"), b.split("~")
        return "~".join([key if key == other else "#", *(str(int(u) + int(v)) for u, v in zip(x, y, strict=True))])
    if isinstance(a, str) or isinstance(b, str) or len(a[1]) != len(b[1]):  # a group of one item and that item
        group, one = (b, a) if isinstance(a, str) or not isinstance(b, str) and len(b[1]) == 1 else (a, b)
        return (group[0], (unify(group[1][0], one),))
    kind = "+" if "+" in (a[0], b[0]) else "?"
    return (kind, tuple(unify(x, y) for x, y in zip(a[1], b[1], strict=True)))


def group_singles(items: list, other: list) -> list:
    """Wrap single copies of groups that are repeated elsewhere."""
    for body in {tuple(map(shape, x[1])): x[1] for x in other if not isinstance(x, str) and x[0] != "#" and len(x[1]) > 1}.values():
        want, w, keys = [shape(x) for x in body], len(body), [shape(x) for x in items]
        i, out = 0, []
        while i < len(items):
            if keys[i : i + w] == want:
                out.append(("?", tuple(items[i : i + w])))
                i += w
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def common_lengths(x: np.ndarray, y: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of x and every suffix of y; of every suffix of x, too, into table."""
    row = np.zeros(len(y) + 1, np.int32)
    for i in range(len(x) - 1, -1, -1):
        new = row.copy()
        new[:-1] = np.maximum(new[:-1], np.where(y == x[i], row[1:] + 1, 0))
        row = np.maximum.accumulate(new[::-1])[::-1]
        if table is not None:
            table[i] = row
    return row


def matches(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence; what exceeds CELLS is split where its halves have most in common."""
    n, m = len(x), len(y)
    if n * m > CELLS and n > 1:
        half = n // 2
        before, after = common_lengths(x[:half][::-1], y[::-1])[::-1], common_lengths(x[half:], y)
        cut = int(np.argmax(before + after))
        return matches(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in matches(x[half:], y[cut:])]
    table = np.zeros((n + 1, m + 1), np.int32)
    common_lengths(x, y, table)
    best, ka, kb = table.tolist(), x.tolist(), y.tolist()
    out, i, j = [], 0, 0
    while i < n and j < m:
        if ka[i] == kb[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def coded(a: list, b: list) -> tuple[np.ndarray, np.ndarray]:
    codes: dict = {}
    x, y = (np.array([codes.setdefault(shape(v), len(codes)) for v in side], np.int64) for side in (a, b))
    return x, y


def align(a: list, b: list) -> list:
    """The wrapper of two wrappers: common items unified, items of one side alone made optional."""
    if [shape(x) for x in a] == [shape(x) for x in b]:
        return [unify(x, y) for x, y in zip(a, b, strict=True)]
    a, b = group_singles(a, [*a, *b]), group_singles(b, [*a, *b])

    def optional(x):
        return x if not isinstance(x, str) and x[0] in "?+" and len(x[1]) == 1 else ("?", (x,))

    out, i, j = [], 0, 0
    for k, l in [*matches(*coded(a, b)), (len(a), len(b))]:
        out += [*map(optional, a[i:k]), *map(optional, b[j:l])]
        if k < len(a):
            out.append(unify(a[k], b[l]))
        i, j = k + 1, l + 1
    return out


def merged(streams) -> list:
    """One wrapper of all streams or wrappers, iteratively; the empty ones are left out."""
    wrapper: list = []
    for items in streams:
        if items:
            wrapper = align(wrapper, items) if wrapper else items
    return wrapper


def infer(pages: list[str | None]) -> list:
    """Fold pages into one wrapper, iteratively."""
    return merged(map(stream, pages))


def pattern(items) -> str:
    """The wrapper as a regular expression over tags."""
    return "".join(x.split("~")[0] if isinstance(x, str) and x[0] in "#=" else f"<{x}>" if isinstance(x, str) else f"({pattern(x[1])}){x[0]}" for x in items)


def load_wrapper(s: str) -> list:
    return [x if isinstance(x, str) else _group(x) for x in json.loads(s)]


def _group(x) -> tuple:
    return (x[0], tuple(y if isinstance(y, str) else _group(y) for y in x[1]))


# -- the article in a wrapper -------------------------------------------------------------------------


def texts_in(item) -> list[list[str]]:
    """The texts of an item, each as [key, texts, characters, characters of links]."""
    if isinstance(item, str):
        return [item.split("~")] if item[0] in "=#" else []
    return [t for x in item[1] for t in texts_in(x)]


def tag_of(item) -> str | None:
    """The tag of a tag or of an optional tag."""
    while not isinstance(item, str) and len(item[1]) == 1:
        item = item[1][0]
    return item if isinstance(item, str) and item[0] not in "=#" else None


def unwanted(tag: str) -> bool:
    return tag.endswith("+") or tag in DROPPED


class Article:
    """The part of a wrapper [start, end) that is the article, and which of its items are text."""

    def __init__(self, items: list):
        self.items = items
        size, varied = np.zeros(len(items)), np.zeros(len(items))
        inner: list[int] = [-1] * len(items)  # the element that each item lies in
        close: dict[int, int] = {}
        stack: list[int] = []
        bad = 0
        for k, x in enumerate(items):
            tag = tag_of(x)
            inner[k] = stack[-1] if stack else -1
            if tag is None:
                t = texts_in(x)
                tags = [y for y in (x[1] if not isinstance(x, str) else ()) if isinstance(y, str) and y[0] not in "=#/"]
                n, chars, linked = (sum(int(y[c]) for y in t) for c in (1, 2, 3))
                if t and not bad and not any(map(unwanted, tags)) and not (linked > 0.7 * chars and n > 2):
                    size[k] = chars
                    varied[k] = sum(int(y[2]) for y in t if y[0] == "#" or int(y[1]) < 2)
            elif tag[0] != "/":
                stack.append(k)
                bad += unwanted(tag)
            else:
                while stack and tag_of(items[stack[-1]]) != tag[1:] and any(tag_of(items[j]) == tag[1:] for j in stack):
                    j = stack.pop()
                    close[j], bad = k, bad - unwanted(tag_of(items[j]))
                if stack and tag_of(items[stack[-1]]) == tag[1:]:
                    j = stack.pop()
                    close[j], bad = k, bad - unwanted(tag[1:])
                    inner[k] = stack[-1] if stack else -1
        copies = varied.sum() < 0.2 * size.sum()  # nearly all is constant: copies of one page, no template
        good = size if copies else varied
        total = np.concatenate([[0.0], np.cumsum(good)])
        seen = [max((int(t[1]) for t in texts_in(x)), default=0) for x in items]
        self.constant = np.array([not copies and size[k] > 0 and varied[k] == 0 and seen[k] > 2 for k in range(len(items))])
        self.wanted = size > 0
        heading = {k for k, x in enumerate(items) if (tag_of(x) or "") in ("h1", "h2")}
        start, end, here = 0, len(items), -1
        while True:
            inside = [k for k in close if inner[k] == here and start <= k < end and close[k] < end]
            best = max(inside, key=lambda k: total[close[k]] - total[k], default=None)
            if best is None or tag_of(items[best]) in LEAVES or total[close[best]] - total[best] < max(1.0, MOST * (total[end] - total[start])):
                break
            if here >= 0 and (tag_of(items[here]) in ("article", "main") or any(start <= k < end and not best < k < close[best] and self.varies(k, good) for k in heading)):
                break
            start, end, here = best, close[best], best
        self.start, self.end = start, end
        self.named = here >= 0 and tag_of(items[here]) in ("article", "main")  # then all in it is the article's

    def varies(self, heading: int, good: np.ndarray) -> bool:
        """Whether the heading that opens at this place holds text of the article."""
        return any(good[k] > 0 for k in range(heading + 1, min(heading + 3, len(good))))

    def text_of(self, found: list) -> list[str]:
        """The blocks of a page at slots and groups of the article; what aligns with nothing goes with the place before it."""
        items = group_singles(folded(found), self.items)
        at = dict(matches(*coded(items, self.items)))
        place, kept = -1, []
        for k, x in enumerate(items):
            place = at.get(k, place)
            numbers = _numbers(x)
            if not numbers or not self.start <= place < self.end:
                continue
            if not self.named and k in at and (self.constant[place] or not self.wanted[place]) and self.fits(place, numbers, found):
                continue
            kept += [n for n in numbers if not dropped(found[n][0])]
        return [found[n][1] for n in sorted(kept)]

    def fits(self, place: int, numbers: list[int], found) -> bool:
        """Whether the page has the wrapper's own constants there, or texts that the wrapper knows for link lists."""
        keys = {t[0] for t in texts_in(self.items[place]) if t[0] != "#"}
        return not self.constant[place] or all("=" + text_key(found[n][1]) in keys for n in numbers)


def _numbers(x) -> list[int]:
    if isinstance(x, str):
        return []
    return list(x[1]) if x[0] == "#" else [n for y in x[1] for n in _numbers(y)]


def dropped(path: tuple[str, ...]) -> bool:
    """Whether the elements around a block say that it is no text of an article. A heading in an article's header is."""
    if any(map(unwanted, path)):
        return True
    if "header" not in path:
        return False
    inside = max((i for i, t in enumerate(path) if t in ("article", "main")), default=len(path))
    return not ("header" in path[inside:] and re.fullmatch(r"h[1-6]", path[-1]))


def main_text(html: str | None, article: Article | None = None) -> str:
    """The text of a page by its host's wrapper; by its own if there is none or the page has nothing there."""
    found = blocks(html)
    kept = article.text_of(found) if article is not None else []
    return "\n".join(kept or (Article(stream_of(found)).text_of(found) if found else []))


# -- tables -----------------------------------------------------------------------------------------


def wrap_hosts(pages: DataFrame) -> DataFrame:
    """host, n_pages, wrapper (JSON): 4096 salted parts of a host are folded on their own, then 64, then one."""
    host, _ = url_rules.host_and_path(F.col("`url`"))
    part = F.pmod(F.xxhash64("`page_id`", "`url`"), F.lit(4096)).cast("int")
    d = pages.select(host.alias("host"), part.alias("part"), F.col("`html`").alias("html"))

    def shapes(it):
        for pdf in it:
            yield pd.DataFrame({"host": pdf["host"], "part": pdf["part"], "items": [json.dumps(stream(h)) for h in pdf["html"]], "n": 1})

    def merge(it):
        key, wrapper, last, n = None, [], None, 0
        for pdf in it:
            out = []
            for h, p, s, c in zip(pdf["host"], pdf["part"], pdf["items"], pdf["n"], strict=True):
                if key != (h, p):
                    if key is not None:
                        out.append((*key, json.dumps(wrapper), n))
                    key, wrapper, last, n = (h, p), [], None, 0
                n += c
                if s != last:  # equal streams lie side by side
                    wrapper, last = merged([wrapper, load_wrapper(s)]), s
            yield pd.DataFrame(out, columns=["host", "part", "items", "n"])
        if key is not None:
            yield pd.DataFrame([(*key, json.dumps(wrapper), n)], columns=["host", "part", "items", "n"])

    kind = "host string, part int, items string, n long"
    level = d.mapInPandas(shapes, kind)
    for parts in (4096, 64, 1):
        level = level.withColumn("part", F.pmod("part", F.lit(parts))).repartition("host", "part").sortWithinPartitions("host", "part", "items").mapInPandas(merge, kind)
    return level.select("host", F.col("n").alias("n_pages"), F.col("items").alias("wrapper"))


def extract(pages: DataFrame, owner: str = "wrappers") -> DataFrame:
    """page_id, url, text, n_chars, and the regular expression of the page's host."""
    w = common.stored(wrap_hosts(pages), "wrappers", owner)
    host, _ = url_rules.host_and_path(F.col("`url`"))
    d = pages.select(F.col("`page_id`").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"), host.alias("host")).join(w, "host", "left")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(it):
        seen: dict = {}
        for pdf in it:
            out = []
            for h, s in zip(pdf["html"], pdf["wrapper"], strict=True):
                if s not in seen:
                    if len(seen) > 1000:
                        seen.clear()
                    items = load_wrapper(s or "[]")
                    seen[s] = Article(items) if items else None, pattern(items)
                article, expression = seen[s]
                t = main_text(h, article)
                out.append((t, len(t), expression))
            yield pd.concat([pdf[["page_id", "url"]].reset_index(drop=True), pd.DataFrame(out, columns=["text", "n_chars", "wrapper"])], axis=1)

    return d.select("page_id", "url", "html", "wrapper").mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long, wrapper string")
