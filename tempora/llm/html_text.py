"""HTML extraction by consensus host paths: pages score their containers, hosts vote on generalised tag-class paths, pages are re-extracted by the winning paths."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table, text_slices, thrifty, without

#: A path wins on a host if it has this share of its pages' votes; the first one wins in any case.
WINNING_SHARE = 0.2
#: A block is the host's own if it is on so many of its pages, and on this share of them.
LEAST_PAGES, OWN_SHARE = 3, 0.5
#: Share of linked text from which an element with a doubtful name isn't article text.
LINKED = 0.5
#: Bytes of winning paths that are broadcast; more are joined.
BROADCAST_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("body article main section div td".split())
BLOCKS = CONTAINERS | frozenset("address blockquote br caption center dd details dir dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li ol p pre summary table tbody tfoot th thead tr ul html".split())
#: Elements without article text, and words that name such an element in its class or id if nothing but neutral words stands beside them.
DROPPED = frozenset("head nav header footer aside form button select option dialog menu svg math object audio video canvas map datalist".split())
READERS_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
ADVERT_WORDS = frozenset("ad ads adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe share sharing social related recommended".split())
LAYOUT_WORDS = frozenset("banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget header masthead topbar footer foot copyright cookie cookies consent gdpr notice notices popup modal overlay signup login pagination pager".split())
DROPPED_WORDS = READERS_WORDS | ADVERT_WORDS | LAYOUT_WORDS
NEUTRAL_WORDS = frozenset("area bar block body bottom box button buttons card center col column container content count count2 entry feed form group header heading holder icon icons inner item items left link links list main menu module navigation outer page panel post posts reader readers right row section site slot small story text thread title top unit user users view wrap wrapper zone".split())
#: Beginnings of words that readers' parts have in several languages, names of advert networks, and words that an article's own section may have, too.
READERS_STEMS = ("comment", "coment", "komment", "comentari", "reacti", "reactie", "reakti", "lesermeinung", "guestbook", "opinion")
NETWORKS = frozenset("outbrain taboola revcontent zergnet mgid teads criteo doubleclick dfp".split())
DOUBLE_WORDS = ("discuss", "diskuss", "feedback", "forum", "respons")
#: What a name says of an element: nothing, a word among others, a word that articles use, too, a readers' or advert word, no article text.
PLAIN, MIXED, DOUBLE, DOUBTFUL, GONE = range(5)
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names that begin so say what a page is like, not what the element is: has-sidebar, no-comments.
LIKENESS = frozenset("has is no not with without".split())
#: Names of an article's own element; a composite name beside one of them (layout-sidebar) doesn't drop it.
MAIN_NAMES = frozenset("article article-body article-content articlebody entry-content main main-content post-body post-content story-body".split())
MAIN_WORDS = frozenset("article content entry main post story text body".split())
BONUS = {"article": 4.0, "main": 2.0}
HEADINGS = frozenset("h1 h2 h3".split())
CODE = frozenset("pre code".split())
INLINE = frozenset("a abbr b bdi bdo cite em font i ins kbd label mark q s samp small span strong sub sup time tt u var".split())
#: Elements that end an open one of their own kind, in which they cannot lie.
SIBLINGS = frozenset("p li dt dd td th tr option".split())
#: Attributes up to the end of a tag. Only what follows = is quoted; a quote that never closes is a character like others. No part of it is read twice.
REST = r"""(?>[^>"'=]++|=\s*+(?>"[^"]*+"|'[^']*+'|)|["'])*+"""
#: Tags, comments and elements whose text isn't markup; what never ends goes on to the end of the page, so that no place is read once for each tag before it.
TOKEN = re.compile(
    r"<!--(?>-?>|.*?(?:--!?>|\Z))|<(script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>])" + REST + r">.*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)(" + REST + r")(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+|"[^"]*+"|'[^']*+'""")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
SPLIT = re.compile(r"[^a-z0-9]+")
DIGITS = re.compile(r"\d+")


@dataclass
class Page:
    """Containers by number (parent, path) and blocks of text (container, text, characters outside links) in page order; dropped elements have none.

    Paths are numbered, too, by the path above and their last step, so that deep pages take no more room than long ones.
    """

    steps: dict[tuple[int, str], int] = field(default_factory=lambda: {(-1, "body"): 0})
    paths: list[int] = field(default_factory=lambda: [0])
    parents: list[int] = field(default_factory=lambda: [0])
    weights: list[float] = field(default_factory=lambda: [1.0])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    doubts: list[int] = field(default_factory=lambda: [PLAIN])
    headed: list[bool] = field(default_factory=lambda: [False])

    def add(self, parent: int, step: str, weight: float, doubt: int = PLAIN) -> int:
        self.paths.append(self.steps.setdefault((self.paths[parent], step), len(self.steps)))
        self.parents.append(parent)
        self.weights.append(weight)
        self.doubts.append(doubt)
        self.headed.append(False)
        return len(self.paths) - 1

    def name(self, path: int) -> str:
        above, out = {n: key for key, n in self.steps.items()}, []
        while path >= 0:
            path, step = above[path]
            out.append(step)
        return ">".join(reversed(out))

    def find(self, name: str) -> int | None:
        at: int | None = -1
        for step in name.split(">"):
            at = self.steps.get((at, step))
            if at is None:
                return None
        return at

    def scores(self) -> list[float]:
        """Text outside links of each container and, less so, of those inside it; more for what is marked as an article."""
        own = [0.0] * len(self.paths)
        for c, _, n in self.blocks:
            own[c] += n
        for c in range(len(own) - 1, 0, -1):
            own[self.parents[c]] += 0.75 * own[c]
        return [s * w for s, w in zip(own, self.weights, strict=True)]

    def best(self) -> str | None:
        """The path of the container of the best score, the first of equals."""
        scores = self.scores()
        return self.name(self.paths[max(range(len(scores)), key=scores.__getitem__)]) if self.blocks else None

    def text(self, path: str, own: frozenset[int] = frozenset()) -> str:
        """Blocks of all containers of the path and of what they hold, less those that the evidence speaks against."""
        at, inside = self.find(path), [False] * len(self.paths)
        doubt = [-1] * len(self.paths)  # the outermost doubtful container at or above, below the path's own
        for c, p in enumerate(self.paths):
            above = c > 0 and inside[self.parents[c]]
            inside[c] = p == at or above
            if above:
                up = doubt[self.parents[c]]
                doubt[c] = up if up >= 0 else c if self.doubts[c] else -1
        blocks = [(doubt[c], t, n) for c, t, n in self.blocks if inside[c]]
        return " ".join(t for _, t, _ in self.without_own(self.without_doubtful(blocks), own))

    def without_doubtful(self, blocks: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """blocks (doubtful container or -1, text, characters outside links) less those of doubtful containers that are mostly links or, for names that speak of readers and adverts, come after all other text; a heading shows that a section named by a word of two senses is the article's."""
        if all(d < 0 for d, _, _ in blocks):
            return blocks
        size: Counter = Counter()
        free: Counter = Counter()
        for d, t, n in blocks:
            size[d] += len(t)
            free[d] += n
        gone = {d for d in size if d >= 0 and free[d] <= (1 - LINKED) * size[d]}
        for d, _, _ in reversed(blocks):
            if d in gone:
                continue
            if d < 0 or self.doubts[d] == MIXED or self.doubts[d] == DOUBLE and self.headed[d]:
                break
            gone.add(d)
        left = [x for x in blocks if x[0] not in gone]
        return left or blocks

    @staticmethod
    def without_own(blocks: list[tuple[int, str, int]], own: frozenset[int]) -> list[tuple[int, str, int]]:
        """blocks less those that are the host's own, unless the page has no others."""
        return [x for x in blocks if block_hash(x[1]) not in own] or blocks if own else blocks

    def hashes(self) -> dict[int, int]:
        """Length of each distinct block."""
        return {block_hash(t): len(t) for _, t, _ in self.blocks}

    def chosen(self, winners: list[str], own: frozenset[int] = frozenset()) -> str:
        """The text of the first of the winning paths that holds any; else of the page's own best path."""
        if not self.blocks:
            return ""
        full = [False] * len(self.paths)
        for c, _, _ in self.blocks:
            full[c] = True
        for c in range(len(full) - 1, 0, -1):
            full[self.parents[c]] |= full[c]
        have = {p for p, f in zip(self.paths, full, strict=True) if f}
        return self.text(next((w for w in winners if self.find(w) in have), None) or self.best(), own)


def block_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


@dataclass
class Marks:
    """What an element's attributes say: generalised classes, names (class and id), their words, hidden or of a role without article text."""

    classes: str = ""
    names: list[str] = field(default_factory=list)
    words: set[str] = field(default_factory=set)
    gone: bool = False

    def says(self, tag: str, inline: bool) -> int:
        """PLAIN to GONE. A name drops an element only if all its words say so, or are neutral; inline elements go as adverts only, and article, main and what is named as the article itself not by words of layout."""
        if self.gone:
            return GONE
        own, worst = tag in ("article", "main") or not MAIN_NAMES.isdisjoint(self.names), PLAIN
        for name in self.names:
            words = [w for w in SPLIT.split(name) if w and not w.isdigit()]
            if not words or words[0] in LIKENESS:
                continue
            bad = DROPPED_WORDS.intersection(words)
            if inline:
                bad &= ADVERT_WORDS
            elif own and len(words) > 1:
                bad -= LAYOUT_WORDS
            others = [w for w in words if w not in DROPPED_WORDS and w not in NEUTRAL_WORDS]
            if bad and not others:
                return GONE
            if inline or own:
                continue
            if bad:
                worst = max(worst, MIXED)
            elif others and all(w.startswith(READERS_STEMS) or w in NETWORKS for w in others):
                worst = max(worst, DOUBTFUL)
            elif others and all(w.startswith(DOUBLE_WORDS) for w in others):
                worst = max(worst, DOUBLE)
        return worst


def marks(attributes: str) -> Marks:
    out = Marks()
    for m in ATTRIBUTE.finditer(attributes):
        if not m[1]:
            continue
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "class" and not out.classes:
            out.classes = "".join("." + c for c in sorted({DIGITS.sub("#", x).replace(">", "_") for x in value.lower().split()}))
        if name in ("class", "id"):
            names = [HUMP.sub("-", x).lower() for x in value.split()]
            out.names += names
            out.words.update(w for x in names for w in SPLIT.split(x) if w)
        out.gone |= name == "hidden" and value.lower() != "until-found" or name == "style" and "display:none" in "".join(value.lower().split()) or name == "role" and value.strip().lower() in DROPPED_ROLES
    return out


NO_MARKS = Marks()


def parse(source: str) -> Page:
    page = Page()
    stack: list[tuple[str, int]] = [("body", 0)]  # open (tag, container); a negative container is inside a dropped element
    depth: Counter = Counter()  # open elements of each tag
    parts: list[str] = []
    links = linked = at = here = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.blocks.append((here, text, max(0, len(text) - linked)))
            parts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked, here
        if stack[-1][1] >= 0 and piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            here = stack[-1][1]
            parts.append(piece)
            linked += len(piece) if links else 0

    def push(tag: str, container: int) -> None:
        stack.append((tag, container))
        depth[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        depth[tag] -= 1
        return tag

    for m in TOKEN.finditer(source):
        say(source[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag == "a":
            links = 0 if m[2] else 1
        block = tag in BLOCKS
        if block or tag in DROPPED:
            flush()
        if m[2]:
            if depth[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        if tag in SIBLINGS and stack[-1][0] == tag or block and tag != "p" and stack[-1][0] == "p":
            pop()
        above = stack[-1][1]
        said = marks(m[4]) if m[4] and not m[4].isspace() else NO_MARKS
        inline = not block
        if above < 0:
            if (block or depth[tag] or tag not in INLINE) and not m[4].endswith("/"):
                push(tag, -1)
            continue
        doubt = GONE if tag in DROPPED or said.gone else said.says(tag, inline) if said.words and not (inline and any(depth[x] for x in CODE)) else PLAIN
        if doubt == GONE:
            if not m[4].endswith("/"):
                push(tag, -1)
        elif block or tag in CODE:
            if tag in CONTAINERS:
                above = page.add(above, tag + said.classes, BONUS.get(tag, 1.5 if said.words & MAIN_WORDS else 1.0) * (0.5 if doubt > MIXED else 1.0), doubt)
            elif doubt:
                above = page.add(above, tag + said.classes, 0.5, doubt)
            if tag in HEADINGS:
                page.headed[above] = True
            push(tag, above)
    say(source[at:])
    flush()
    return page


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages with text string: the main text of the whole html.

    Each page votes for the path of its best container; a host's winning paths are those with
    WINNING_SHARE of its votes, and the first. A page's text is that of its containers of the winning
    path with most votes that it has; without one, that of its own best container. Pages of no host
    (null or odd url) vote among themselves.

    Of that text three kinds of blocks go. Those of elements that aren't article text by tag, role, or a
    name all of whose words say so. Those of elements whose name only hints at readers or adverts, where
    they are mostly links or follow all other text; a hint among other words (share-price) counts where
    the element is mostly links. And those that are the host's own: the same block on OWN_SHARE of its
    pages, and on LEAST_PAGES at least; but not on a host where they are most of the text, as its pages
    are copies of one another then, nor on a page that has no other blocks.

    Null and empty html give ''. Blocks are trimmed, their white space (Unicode's) is one space, and one
    space joins them in page order. Tags are read as HTML5 reads them, but that a quote which never
    closes doesn't take the rest of the page; an unfinished last tag is no text. Time and memory are in
    proportion to a page, however deep or broken it is. Equal scores go to the first container, equal
    votes to the greater path. Repeated rows vote and stay, each. Columns called text are replaced,
    others stay; an empty table gives no rows.
    """
    (host, won) = fresh(pages, "_host", "_won")
    pages = without(pages, "text").withColumn(host, host_of(F.col("url")))
    names = pages.columns[:-1]

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count: Counter = Counter()
            blocks: Counter = Counter()
            chars: Counter = Counter()
            hosts = b.column(0).to_pylist()
            for lo, hi, raw, off in text_slices(b, 1):
                data = raw.tobytes()
                for i in range(hi - lo):
                    page = parse(data[off[i] : off[i + 1]].decode())
                    if path := page.best():
                        held = page.hashes()
                        count[hosts[lo + i], path] += 1
                        chars[hosts[lo + i], path] += sum(held.values())
                        for x, n in held.items():
                            blocks[hosts[lo + i], x] += 1
                            chars[hosts[lo + i], x] += n
            both = [(h, p, None, n, chars[h, p]) for (h, p), n in count.items()] + [(h, None, x, n, chars[h, x]) for (h, x), n in blocks.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in both], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["h", "path", "block", "votes", "chars"])

    # blocks of one page only stay in the sums of their task and host; those of fewer than LEAST_PAGES go at once
    said = cut(pages.select(host, "html").mapInArrow(thrifty(votes), "h string, path string, block long, votes long, chars long").groupBy("h", "path", "block").agg(F.sum("votes").alias("votes"), F.sum("chars").alias("chars")).filter(F.col("path").isNotNull() | (F.col("votes") >= LEAST_PAGES)))
    counted = said.filter("path IS NOT NULL").drop("block")
    total = counted.groupBy("h").agg(F.sum("votes").alias("total"), F.sum("chars").alias("all_chars"), F.max(F.struct("votes", "path")).alias("first"))
    own = said.filter("block IS NOT NULL").drop("path").join(total.select("h", "total", "all_chars"), "h").filter(F.col("votes") >= OWN_SHARE * F.col("total"))
    own = own.groupBy("h").agg(F.when(2 * F.sum("chars") <= F.first("all_chars"), F.collect_list("block")).alias("own"))  # blocks of a page over OWN_SHARE at most, on average
    winners = cut(
        counted.drop("chars").join(total, "h").filter((F.col("votes") >= WINNING_SHARE * F.col("total")) | (F.col("path") == F.col("first.path")))
        .groupBy("h").agg(F.reverse(F.array_sort(F.collect_list(F.struct("votes", "path")))).alias("w"))  # 1 / WINNING_SHARE + 1 of a host at most
        .join(own, "h", "left").select(F.col("h").alias(won + "h"), F.struct(F.col("w.path").alias("paths"), F.coalesce("own", F.array().cast("array<bigint>")).alias("own")).alias(won))
    )
    size = winners.agg(F.sum(F.octet_length(won + "h") + F.octet_length(F.array_join(f"{won}.paths", "")) + 8 * F.size(f"{won}.own"))).first()[0] or 0
    joined = pages.join(F.broadcast(winners) if size <= broadcast_bytes else winners, F.col(host) == F.col(won + "h"), "left")
    ready = joined.select(*[F.col(f"`{c}`") for c in names], won)
    at, at_won = names.index("html"), len(names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema][:-1] + ["text string"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, texts = b.column(at_won), []
            paths, owns = known.field("paths").to_pylist(), known.field("own")
            sets: dict[bytes, frozenset[int]] = {}
            valid = known.is_valid().to_pylist()

            def own_of(row: int) -> frozenset[int]:
                x = owns[row].values.to_numpy() if valid[row] else np.zeros(0, np.int64)
                return sets.setdefault(x.tobytes(), frozenset(x.tolist())) if len(x) else frozenset()

            for lo, hi, raw, off in text_slices(b, at):
                data = raw.tobytes()
                for i in range(hi - lo):
                    texts.append(parse(data[off[i] : off[i + 1]].decode()).chosen((paths[lo + i] if valid[lo + i] else None) or [], own_of(lo + i)))
            yield pa.RecordBatch.from_arrays([*b.columns[:at_won], pa.array(texts, pa.string())], names=[*names, "text"])

    return ready.mapInArrow(thrifty(again), schema)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page, in the manner of extract; n_chars is a text's code points."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
