"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read once into blocks: runs of text between block-level boundaries, with the tags, classes, ids and roles of
their ancestors. Each block gets features from its ancestors and from its text; the field has two states (main, other),
a weight per feature and a weight per transition, and is decoded by Viterbi. It is trained on a bounded sample of pages
whose markup says what is main (an ``article`` or ``main`` element). Those pages are also rebuilt in other layouts,
with the labels kept: other containers and class names, and menus, notices, adverts, forms, comments and so on around
and inside the text, whose wording comes from the sample too. So neither one tag nor the wording alone decides.

Defined cases: null html is empty; a page without blocks, or without main blocks, gives an empty text; nothing is cut
or dropped from a main block; repeated rows are rows of their own; an empty table gives no rows; other columns are
ignored. White space is what ``str.split`` takes for it; ``br`` is white space. If the sample holds no labelled page,
the layouts are filled with invented words. Unknown tags and classes carry no weight.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES, TRAIN_BYTES, TRAIN_BLOCKS = 300, 200_000, 300  # the training sample: pages, bytes of a page, blocks of a page
LAYOUTS, ROUNDS, RATE, RIDGE, BATCHES = 5, 200, 0.1, 0.00002, 12  # rebuilt pages for each page of the sample; steps, step size, penalty and batches of the training

# Elements that break text into blocks, that never have content, and whose content is not shown.
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td
 tfoot th thead tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style template title noscript svg iframe object canvas audio video head math noframes".split())
CLOSED_BY = {  # an open element that a start tag ends, and the elements beyond which it doesn't look
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
SIMPLE = set("b a i em strong span p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 td th tr table tbody thead tfoot caption blockquote pre figure figcaption".split())
KEEPS_P_OPEN = {"table", "td", "th", "caption", "html", "body", "button", "object"}
# Words that tell something about a short block.
CUES = set("""about accept account ads advert advertisement advertising archive author back cart categories category click comment comments
 contact continue cookie cookies copyright email facebook follow home imprint instagram latest linkedin login logout menu more newer news
 newsletter next notice older password pinterest popular previous privacy promoted read recent register related replies reply reserved rights
 rss search share sign signup sitemap skip sponsored submit subscribe tags terms trending tweet twitter unsubscribe username""".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s/>]*)[^>]*>|<[a-zA-Z][^>]*>|<[/!?][^>]*>|<[a-zA-Z/!?][^>]*\Z""", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
NAME_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[^\W\d_A-Za-z]+")


class Frame:
    """An open element: its tag, its own features and the frame around it. A model fills in ``score`` (the weights of the
    element and those around it) and ``inside`` (the same for a block that stands in it)."""
    __slots__ = ("tag", "up", "own", "score", "inside")

    def __init__(self, tag: str, up: Frame | None, own: tuple[str, ...]):
        self.tag, self.up, self.own, self.score, self.inside = tag, up, own, None, None


@dataclass
class Block:
    text: str
    frame: Frame
    linked: int  # characters inside links
    words: int
    place: int = 0
    last: bool = False
    title: bool = False  # equals the start of the page's title
    features: list[str] = field(default_factory=list)


@lru_cache(20_000)
def tag_features(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"tag:{tag}"]
    for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            parts = NAME_PART.findall(entities.unescape(value))
            out += [f"name:{p.lower()}" for p in parts]
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack = [Frame("#", None, ())]
    open_tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked, links, title, at = 0, 0, "", 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            words = "".join(pieces).split()
            if words:
                frame = stack[-1]
                while frame.tag not in BLOCK and frame.up is not None:
                    frame = frame.up
                out.append(Block(" ".join(words), frame, linked, len(words)))
            pieces.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        if "&" in s:
            s = entities.unescape(s)
        pieces.append(s)
        if links:
            linked += len(s)

    def close(names: set[str] | tuple[str, ...], beyond: set[str]) -> None:
        """End the nearest open element of ``names``, with all that is open inside it."""
        nonlocal links
        if not any(open_tags[n] for n in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                for f in stack[i:]:
                    links -= f.tag == "a"
                    open_tags[f.tag] -= 1
                del stack[i:]
                return
            if stack[i].tag in beyond:
                return

    while m := TOKEN.search(page, at):  # not finditer: what is skipped isn't looked at
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        start, end = m.group(1), m.group(3)
        if start:
            tag = start.lower()
            if tag in HIDDEN:
                if tag == "head":
                    continue
                skip = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if tag == "title" and not title:
                    title = " ".join(entities.unescape(page[at:skip.start() if skip else len(page)]).split())
                at = skip.start() if skip else len(page)
                continue
            if tag == "br":
                pieces.append(" ")
                continue
            if tag in BLOCK:
                flush()
                close(("p",), KEEPS_P_OPEN)
                if tag in CLOSED_BY:
                    close(*CLOSED_BY[tag])
            elif tag in ("img", "input", "button", "select", "textarea", "label"):
                pieces.append(" ")
            if tag not in VOID and not (m.group(2).endswith("/") and tag not in BLOCK):
                stack.append(Frame(tag, stack[-1], tag_features(tag, m.group(2))))
                open_tags[tag] += 1
                links += tag == "a"
        elif end:
            tag = end.lower()
            if tag in BLOCK:
                flush()
                close((tag,), set())
            elif tag in ("button", "select", "textarea", "label"):
                pieces.append(" ")
                close((tag,), BLOCK)
            else:
                close((tag,), BLOCK)
    if at < len(page):
        text(page[at:])
    flush()
    for i, b in enumerate(out):
        b.place, b.last = i, i == len(out) - 1
        b.title = bool(title) and len(title) > 8 and (b.text.startswith(title) or title.startswith(b.text) and 2 * len(b.text) > len(title))
    return out


def text_features(b: Block) -> list[str]:
    text, share = b.text, b.linked / len(b.text)
    out = ["bias", f"words:{min(b.words, 256).bit_length()}", f"links:{0 if not b.linked else 1 if share < 0.34 else 2 if share < 0.67 else 3}",
           f"parent:{b.frame.tag}"]
    if text[-1] in ".!?…。\"'”»":
        out.append("sentence")
    if b.words > 20:
        out.append("prose")
    if "©" in text:
        out.append("copyright")
    if b.title:
        out.append("title")
    if b.place == 0:
        out.append("first")
    if b.last:
        out.append("last")
    if b.words <= 12:
        out += [f"cue:{w}" for w in set(re.findall(r"[a-z]+", text.lower())) & CUES]
    return out


def box_features(frame: Frame | None) -> list[str]:
    """The innermost element that isn't just a paragraph, list, table or heading."""
    while frame is not None and frame.tag in SIMPLE:
        frame = frame.up
    return [f"box:{x}" for x in frame.own] if frame is not None else []


def ancestor_features(frame: Frame | None) -> list[str]:
    out = box_features(frame)
    while frame is not None:
        out += frame.own
        frame = frame.up
    return out


@dataclass
class Model:
    """Weights in favour of the main state: per feature, for starting in it, and per change of state."""
    weights: dict[str, float]
    start: np.ndarray
    moves: np.ndarray

    def emission(self, b: Block) -> float:
        if b.frame.inside is None:
            b.frame.inside = self.above(b.frame) + sum(self.weights.get(f, 0.0) for f in box_features(b.frame))
        return b.frame.inside + sum(self.weights.get(f, 0.0) for f in text_features(b))

    def above(self, frame: Frame | None) -> float:
        chain = []
        while frame is not None and frame.score is None:
            chain.append(frame)
            frame = frame.up
        total = frame.score if frame is not None else 0.0
        for f in reversed(chain):
            total += sum(self.weights.get(x, 0.0) for x in f.own)
            f.score = total
        return total

    def decode(self, found: list[Block]) -> list[bool]:
        """The best sequence of states (Viterbi)."""
        if not found:
            return []
        (oo, om), (mo, mm) = self.moves.tolist()
        other, main = self.start.tolist()
        main += self.emission(found[0])
        back = []
        for b in found[1:]:
            e = self.emission(b)
            from_other, from_main = main + mo <= other + oo, main + mm >= other + om
            back.append((not from_other, from_main))  # whether the best way to each state comes from main
            other, main = max(other + oo, main + mo), max(other + om, main + mm) + e
        state = main > other
        out = [state]
        for o, m in reversed(back):
            state = m if state else o
            out.append(state)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b.text for b, keep in zip(found, self.decode(found)) if keep)


# Training ---------------------------------------------------------------------------------------
def fit(pages: list[tuple[list[Block], list[bool]]], rounds: int = ROUNDS) -> Model:
    """Maximum likelihood with a penalty, by Adam over all pages at once. Pages of similar length share a batch."""
    pages = sorted(((b[:TRAIN_BLOCKS], y[:TRAIN_BLOCKS]) for b, y in pages if b), key=lambda x: len(x[0]))
    if not pages:
        return Model({}, np.zeros(2), np.zeros((2, 2)))
    names: dict[str, int] = {}
    size = -(-len(pages) // BATCHES)
    batches = [_Batch(pages[i:i + size], names) for i in range(0, len(pages), size)]
    theta = np.zeros(len(names) + 6)  # feature weights, start, moves
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = sum(len(b) for b, _ in pages)
    for step in range(1, rounds + 1):
        grad = sum(b.gradient(theta) for b in batches) / total - RIDGE * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        theta = theta + RATE * first / (1 - 0.9 ** step) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Model({f: float(theta[i]) for f, i in names.items()}, theta[-6:-4].copy(), theta[-4:].reshape(2, 2).copy())


class _Batch:
    """Pages side by side, padded to the longest: ``mask`` and ``gold`` by position and page, features as (cell, number) pairs."""

    def __init__(self, pages: list[tuple[list[Block], list[bool]]], names: dict[str, int]):
        self.shape = t, n = max(len(b) for b, _ in pages), len(pages)
        self.mask, self.gold = np.zeros((t, n), bool), np.zeros((t, n), np.int64)
        rows, cols = [], []
        for p, (b, y) in enumerate(pages):
            self.mask[:len(b), p], self.gold[:len(b), p] = True, y
            for at, x in enumerate(b):
                own = [names.setdefault(f, len(names)) for f in text_features(x) + ancestor_features(x.frame)]
                rows += [at * n + p] * len(own)
                cols += own
        self.rows, self.cols = np.array(rows), np.array(cols)
        self.pairs = np.zeros((2, 2))
        np.add.at(self.pairs, (self.gold[:-1][self.mask[1:]], self.gold[1:][self.mask[1:]]), 1)

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        """Observed minus expected counts: forward and backward sums over positions, all pages of the batch at once."""
        (t, n), mask = self.shape, self.mask
        e = np.zeros((t, n, 2))
        e[:, :, 1] = np.bincount(self.rows, theta[self.cols], t * n).reshape(t, n)
        start, moves = theta[-6:-4], theta[-4:].reshape(2, 2)
        ahead, behind = np.zeros((t, n, 2)), np.zeros((t, n, 2))
        ahead[0] = e[0] + start
        for i in range(1, t):
            into = np.logaddexp(ahead[i - 1][:, :1] + moves[0], ahead[i - 1][:, 1:] + moves[1]) + e[i]
            ahead[i] = np.where(mask[i][:, None], into, ahead[i - 1])
        for i in range(t - 2, -1, -1):
            nxt = e[i + 1] + behind[i + 1]
            behind[i] = np.where(mask[i + 1][:, None], np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:]), 0)
        whole = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
        prob = np.exp(ahead + behind - whole[None, :, None])
        grad = np.zeros_like(theta)
        grad[:-6] = np.bincount(self.cols, ((self.gold - prob[:, :, 1]) * mask).ravel()[self.rows], len(theta) - 6)
        grad[-6:-4] = np.bincount(self.gold[0], minlength=2) - prob[0].sum(axis=0)
        both = np.exp(ahead[:-1, :, :, None] + moves + (e + behind)[1:, :, None, :] - whole[None, :, None, None]) * mask[1:, :, None, None]
        grad[-4:] = (self.pairs - both.sum(axis=(0, 1))).ravel()
        return grad


ASIDE_TAGS = {"nav", "footer", "aside", "form", "header", "dialog"}


def by_markup(page: str) -> tuple[list[Block], list[bool]] | None:
    """Blocks and labels of a page whose markup names its main part, else None."""
    found = blocks(page)
    tags = [[f[4:] for f in ancestor_features(b.frame) if f.startswith("tag:")] for b in found]
    main = "article" if any("article" in t for t in tags) else "main"
    y = [main in t and not ASIDE_TAGS & set(t[:t.index(main)]) for t in tags]
    return (found, y) if any(y) and not all(y) else None


# Names that page authors give to the parts of a page.
MAIN_NAMES = """content post entry article story main body text entry-content post-content article-body main-content story-body post-body
 article-content page-content prose blog-post single-post content-body""".split()
PARTS = {  # part: (tags, names, headings and short texts)
    "menu": ("nav ul div", "menu nav navbar navigation main-menu topnav breadcrumb breadcrumbs tabs toc pagination pager", "Menu|Home|About|Contact|Next|Previous|Skip to content"),
    "header": ("header div", "header site-header masthead top banner topbar branding", "Home|Login|Sign up|Search"),
    "footer": ("footer div", "footer site-footer bottom colophon legal copyright", "© 2024|All rights reserved.|Privacy|Terms|Imprint|Contact"),
    "sidebar": ("aside div section", "sidebar side related widget popular trending recommended more-stories links aside author-box bio", "Related|Popular|Read more|Latest news|Categories|Archive|About the author"),
    "notice": ("div section dialog p aside", "cookie cookie-banner notice consent gdpr alert message warning modal popup overlay paywall info", "We use cookies.|Accept|Notice|Privacy|More"),
    "advert": ("div aside section p ins", "ad ads advert advertisement sponsored promo promoted sponsor adsense ad-slot banner-ad", "Advertisement|Sponsored|Promoted"),
    "form": ("form div fieldset", "form newsletter subscribe signup search search-form login contact-form", "Subscribe|Search|Email|Submit|Sign up|Password|Login"),
    "comments": ("section div ol article aside", "comments comment comment-list replies discussion responses disqus reviews comment-body reader-comments", "Comments|Reply|3 comments|Leave a comment"),
    "share": ("div ul section", "share social sharing share-buttons tags meta byline toolbar", "Share|Tweet|Facebook|Follow|Tags|Print"),
}


def rebuilt(main: list[str], other: list[str], r: random.Random) -> tuple[list[Block], list[bool]]:
    """A page in a random layout around the given main texts; ``other`` gives the wording of the rest."""
    e = entities.escape
    mark = "⁣"  # set before every main text to read the labels off the parsed blocks; taken out again
    line = lambda: e(r.choice(other))
    named = lambda names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="x{r.randrange(99)} {r.choice(names)}"'])

    def part(kind: str) -> str:
        tags, names, short = PARTS[kind]
        tag = r.choice(tags.split())
        attrs = named(names.split()) if tag in ("div", "section", "p", "ins", "ul", "ol", "article") or r.random() < 0.5 else ""
        heads = short.split("|")
        item = lambda: e(r.choice(heads)) if r.random() < 0.4 else " ".join(line().split()[:r.randrange(1, 5)])
        if tag in ("p", "ins"):
            return f"<{tag}{attrs}>{r.choice([line(), item()])}</{tag}>"
        if kind in ("menu", "share", "header") or kind in ("footer", "sidebar") and r.random() < 0.5:
            rows = "".join(f'<li><a href="/x">{item()}</a></li>' for _ in range(r.randrange(1, 8)))
            inner = rows if tag in ("ul", "ol") else f"<ul>{rows}</ul>" if r.random() < 0.6 else " ".join(f'<a href="/y">{item()}</a>' for _ in range(r.randrange(1, 6)))
            inner = inner if tag in ("ul", "ol") or r.random() < 0.5 else f"<h{r.randrange(2, 5)}>{item()}</h3>{inner}"
        elif kind == "form":
            inner = f"<label>{item()}</label><input name=q><p>{line()}</p><button>{item()}</button>"
        elif kind == "comments":
            own = r.choice(["comment", "reply", "comment-body", "response"])
            inner = f"<h3>{item()}</h3>" + "".join(f'<div class="{own}"><p>{line()}</p></div>' for _ in range(r.randrange(1, 5)))
        else:
            inner = r.choice([line(), f"<p>{line()}</p>", f"<h4>{item()}</h4><p>{line()}</p>", f"<p>{item()}</p>"])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    texts = []
    for i, t in enumerate(main):
        tag = "h1" if i == 0 and r.random() < 0.8 else r.choice(["p"] * 12 + ["h2", "li", "blockquote", "div", "pre", "td", "figcaption", "dd"])
        wrap = {"li": "<ul>{}</ul>", "td": "<table><tr>{}</tr></table>", "figcaption": "<figure>{}</figure>", "dd": "<dl>{}</dl>"}.get(tag, "{}")
        t = e(t)
        if len(t) > 40 and r.random() < 0.2:
            cut = t.find(" ", 10)
            t = f'{t[:cut]} <a href="/z">{t[cut + 1:cut + 12]}</a>{t[cut + 12:]}' if cut > 0 and "&" not in t[cut:cut + 20] else t
        texts.append(wrap.format(f"<{tag}>{mark}{t}</{tag}>"))
    inside = []
    for t in texts:
        inside.append(t)
        if r.random() < 0.06:
            inside.append(part(r.choice(["advert", "sidebar", "share", "form", "notice", "menu"])))
    if r.random() < 0.3:
        inside.append(part(r.choice(["comments", "share", "sidebar", "footer"])))
    if r.random() < 0.2:
        inside.insert(0, part(r.choice(["menu", "share", "header", "notice"])))
    body = "".join(inside)
    kind = r.random()
    if kind < 0.35:
        body = f"<article{named(MAIN_NAMES) if r.random() < 0.3 else ''}>{body}</article>"
    elif kind < 0.5:
        body = f"<main>{body}</main>"
    elif kind < 0.95:
        body = f"<div{named(MAIN_NAMES)}>{body}</div>"
    if r.random() < 0.3:
        body = f"<div{r.choice(['', named(['wrapper', 'container', 'page', 'row', 'col', 'layout'])])}>{body}</div>"
    before = [part(k) for k in ("notice", "header", "menu", "advert", "sidebar", "form") if r.random() < 0.4]
    after = [part(k) for k in ("share", "comments", "sidebar", "advert", "form", "notice", "menu", "footer") if r.random() < 0.4]
    r.shuffle(before)
    found = blocks(f"<html><head><title>{e(main[0][:60])}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>")
    y = [b.text.startswith(mark) for b in found]
    for b in found:
        b.text = b.text.replace(mark, "")
    keep = [i for i, b in enumerate(found) if b.text]
    return [found[i] for i in keep], [y[i] for i in keep]


def train(pages: DataFrame, key: str = "page_id", html: str = "html", layouts: int = LAYOUTS) -> Model:
    """A model from at most ``TRAIN_PAGES`` pages of at most ``TRAIN_BYTES`` bytes, those with the least hash of key and
    html, so that the same rows give the same model however they are partitioned."""
    page = F.col(html).cast("string")
    few = pages.where(page.rlike(r"(?i)<(article|main)[\s>]") & (F.octet_length(page) <= TRAIN_BYTES)).select(
        page.alias("page"), F.xxhash64(F.col(key).cast("string"), page).alias("h")).orderBy("h", "page").limit(TRAIN_PAGES)
    labelled = [x for x in (by_markup(row["page"]) for row in few.collect()) if x]
    r = random.Random(11)
    pools = [([b.text for b, y in zip(*x) if y], [b.text for b, y in zip(*x) if not y]) for x in labelled]
    if not pools:
        word = lambda: "".join(r.choice("aeiou bcdfghklmnprstvw".split()[i % 2]) for i in range(r.randrange(2, 9)))
        say = lambda a, b: (" ".join(word() for _ in range(r.randrange(a, b))).capitalize() + ".")
        pools = [([say(3, 9)] + [say(3, 80) for _ in range(r.randrange(1, 12))], [say(1, 12) for _ in range(6)]) for _ in range(60)]
    other = [t for _, o in pools for t in o] + [t for m, _ in pools for t in m[:3]]
    made = [rebuilt(m, other, r) for m, _ in pools for _ in range(layouts)]
    return fit(labelled + [x for x in made if any(x[1])])


def extract(pages: DataFrame, model: Model, key: str = "page_id", html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(key, *carry, text)`` for every page."""
    schema = pages.select(key, *carry).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):  # so that long pages don't pile up
                part = b.slice(at, 64)
                texts = [model.extract(x.as_py()) for x in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[f.name for f in schema])
    names = [f"c{i}" for i in range(len(carry) + 1)]
    source = pages.select(*(F.col(c).alias(n) for c, n in zip((key, *carry), names)), F.col(html).cast("string").alias("html"))
    return source.mapInArrow(run, schema)
