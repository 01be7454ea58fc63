"""Main text of web pages by consensus host paths.

First pass: every page's containers (body, main, article, section, div, td) are scored
by how much of the page's running text they hold and how little else. Each votes for its
generalised path, the chain of tags and classes with digits masked, weighted by its
score. Votes are summed in each task, then per host in Spark, and each host's best path
wins. Second pass: every page is read anew and its text taken from the containers on the
host's winning path; a page that has running text elsewhere too uses the least container around
all of it. So only furniture, and blocks of nothing but links around the text, go.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_hexdigest

from quernstone.llm.work import Work, salt, salted, slices

#: Winning paths are broadcast up to so many bytes, and joined by a shuffle beyond.
BROADCAST_BYTES = 8 << 20
#: Bytes of paths that a task holds before it passes their votes on.
VOTES_HELD = 8 << 20
#: Steps of a path that are written out, and characters of a step; more is hashed.
STEPS_SHOWN, STEP_LENGTH = 32, 256
#: Words from which on a block counts as running text even without a full stop.
RUNNING_WORDS = 8

# HTML's element names by their role here, and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noembed noframes iframe".split())
CONTAINERS = frozenset("body main article section div td".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
FURNITURE = frozenset("head nav footer aside form script style noscript template iframe button select option textarea label svg canvas object audio video dialog menu math title".split())
WHOLE = frozenset("html body main article".split())  # these are no furniture, whatever their classes
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu header masthead topbar footer sidebar rail aside ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert disclaimer newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies breadcrumb breadcrumbs pagination pager popup modal overlay widget widgets toolbar skip".split()
)

#: Words that say nothing beside one of those: "comment-list" is as good as "comments", but
#: "article-comment-policy" only hints.
NEUTRAL_NAMES = frozenset(
    "site page post entry block box wrap wrapper container inner outer area section list item items content body main top bottom left right center global primary secondary "
    "fixed sticky bar panel slot unit link links button buttons icon icons form thread count title heading text row col column group set tag tags user reader new js".split()
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_DIGITS, _CAMEL = re.compile(r"\d+"), re.compile(r"(?<=[a-z])(?=[A-Z])|[-_\s]+")


class Page:
    """A page's blocks of text and its containers.

    blocks: (text, container, characters in links, furniture?). containers: (step, parent,
    digest of the whole path), with parent -1 for none; parents come before children.

    Elements that are furniture by their tag, role, or a class or id of nothing but
    furniture words take their text with them. A class or id with such a word among others
    only hints: the element is furniture if it has no running text, or if half of its text
    is links. Should nothing be left but what names mark as furniture, as where a whole
    page is called "sidebar", names don't count.

    Time and memory follow the page's length, however deep elements are nested.
    """

    def __init__(self, source: str):
        self._names = True
        self._begin(source)
        if self.blocks and all(b[3] for b in self.blocks) and self._named:
            self._names = False
            self._begin(source)

    def _begin(self, source: str) -> None:
        self._named = False
        self.blocks: list[tuple[str, int, int, bool]] = []
        self.containers: list[tuple[str, int, str]] = [("", -1, "")]
        # of the block being read: its text, characters in links, and text of furniture in it
        self._text: list[str] = []
        self._linked = 0
        self._gone: list[str] = []
        # elements that names hint at: parent; each block's innermost one
        self._hints: list[int] = []
        self._hinted: list[int] = []
        # open elements: name, container, furniture?, link?, in an article?, hint
        self._open = [("", 0, False, False, False, -1)]
        # where blocks and elements of each name are in that
        self._open_blocks: list[int] = []
        self._open_at: dict[str, list[int]] = defaultdict(list)
        self._read(source)
        self._judge_hints()

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            if not found:
                break
            if found.start() > at:
                self._words(source[at : found.start()])
            at = found.end()
            name = (found[2] or found[5] or "").lower()
            if not name:
                continue
            if found[1] or found[4]:
                self._end(name)
                continue
            self._start(name, found[3] or "")
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = close.start() if close else size
        if at < size:
            self._words(source[at:])
        self._flush()

    def _words(self, text: str) -> None:
        if self._open[-1][0] in RAW:
            return
        if "&" in text:
            text = html.unescape(text)
        if self._open[-1][2]:
            self._gone.append(text)
            return
        self._text.append(text)
        if self._open[-1][3]:
            self._linked += len(text)

    def _flush(self) -> None:
        _, container, _, _, _, hint = self._open[-1]
        for parts, furniture in ((self._text, False), (self._gone, True)):
            if parts and (text := " ".join("".join(parts).split())):
                self.blocks.append((text, container, min(self._linked, len(text)), furniture))
                self._hinted.append(hint)
        if self._text or self._gone:
            self._text, self._linked, self._gone = [], 0, []

    def _start(self, name: str, attributes: str) -> None:
        if name == "br" or name in ("td", "th"):
            (self._gone if self._open[-1][2] else self._text).append(" ")
        if name in BLOCKS:
            self._flush()
        if name in BLOCKS or name in ("td", "th"):
            self._imply_ends(name)
        if name in VOID:
            return
        _, container, furniture, link, article, hint = self._open[-1]
        classes = ""
        if attributes and not attributes.isspace():
            values = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            classes = _DIGITS.sub("#", ".".join(sorted(set(values.get("class", "").lower().split()))))
            if not furniture:
                furniture = self._is_hidden(values)
            if self._names and name not in WHOLE and not furniture:
                named = self._furniture_names(values)
                if named == "all":
                    furniture = self._named = True
                elif named == "some":
                    self._hints.append(hint)
                    hint = len(self._hints) - 1
        furniture = furniture or name in FURNITURE or (name == "header" and not article)
        if name in CONTAINERS:
            step = f"{name}{'.' + classes if classes else ''}"
            if len(step) > STEP_LENGTH:
                step = f"{step[:STEP_LENGTH]}~{xxh64_hexdigest(step)}"
            self.containers.append((step, container, xxh64_hexdigest(f"{self.containers[container][2]}>{step}")))
            container = len(self.containers) - 1
        here = len(self._open)
        self._open.append((name, container, furniture, link or name == "a", article or name in ("article", "main"), hint))
        self._open_at[name].append(here)
        if name in BLOCKS or name in CONTAINERS:
            self._open_blocks.append(here)

    @staticmethod
    def _is_hidden(values: dict[str, str]) -> bool:
        hidden = "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
        return hidden or values.get("role", "").lower() in FURNITURE_ROLES

    @staticmethod
    def _furniture_names(values: dict[str, str]) -> str:
        """Whether a class or an id is of furniture words, or has some among others."""
        out = ""
        for name in f"{values.get('class', '')} {values.get('id', '')}".split():
            words = {w for x in _CAMEL.split(name) if (w := x.lower()) and not w.isdigit()}
            if not words.isdisjoint(FURNITURE_NAMES):
                if words <= FURNITURE_NAMES | NEUTRAL_NAMES:
                    return "all"
                out = "some"
        return out

    def _judge_hints(self) -> None:
        """Blocks in elements that names only hint at are furniture if the element has no
        running text, or if half of its text is links."""
        if not self._hints:
            return
        sizes, linked = [0] * len(self._hints), [0] * len(self._hints)
        running = [False] * len(self._hints)
        for (text, _, links, _), hint in zip(self.blocks, self._hinted, strict=True):
            if hint >= 0:
                sizes[hint] += len(text)
                linked[hint] += links
                running[hint] |= 2 * links < len(text) and (text.endswith((".", "!", "?", "…", "。", ":")) or len(text.split()) >= RUNNING_WORDS)
        for k in range(len(self._hints) - 1, 0, -1):
            if (parent := self._hints[k]) >= 0:
                sizes[parent] += sizes[k]
                linked[parent] += linked[k]
                running[parent] |= running[k]
        gone: list[bool] = []
        for k, parent in enumerate(self._hints):
            own = not running[k] or 2 * linked[k] >= sizes[k]
            gone.append(own or (parent >= 0 and gone[parent]))
            self._named |= own
        self.blocks = [(text, container, links, furniture or (hint >= 0 and gone[hint])) for (text, container, links, furniture), hint in zip(self.blocks, self._hinted, strict=True)]

    def _close(self, k: int) -> None:
        """Ends the open element at k and all in it."""
        while len(self._open) > k:
            name = self._open.pop()[0]
            self._open_at[name].pop()
            if self._open_blocks and self._open_blocks[-1] == len(self._open):
                self._open_blocks.pop()

    def _imply_ends(self, name: str) -> None:
        """A block ends an open paragraph; an item ends the item before it in its list, a row
        or cell that before it in its table."""
        if name in ("tr", "td", "th"):
            last = lambda *names: max((self._open_at[x][-1] for x in names if self._open_at.get(x)), default=0)
            before, around = (last("tr"), last("table")) if name == "tr" else (last("td", "th"), last("tr", "table"))
            if before > around:
                self._close(before)
            return
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, ())
        if self._open_blocks:
            here = self._open[self._open_blocks[-1]][0]
            if here == "p" or here in ends:
                self._close(self._open_blocks[-1])

    def _end(self, name: str) -> None:
        block = name in BLOCKS or name in CONTAINERS
        if name in BLOCKS:
            self._flush()
        at = self._open_at.get(name)
        # what is no block doesn't end across the block that it is in
        if at and (block or not self._open_blocks or at[-1] > self._open_blocks[-1]):
            self._close(at[-1])

    def path(self, k: int) -> str:
        """The generalised path of a container: its last steps, and if there are more the
        digest of all."""
        steps, top = [], k
        while top > 0 and len(steps) < STEPS_SHOWN:
            steps.append(self.containers[top][0])
            top = self.containers[top][1]
        if top > 0:
            steps.append(f"#{self.containers[k][2]}")
        return ">".join(reversed(steps))

    def scores(self) -> list[float]:
        """How well each container fits the page's running text, 0 to about 1."""
        good, other = [0.0] * len(self.containers), [0.0] * len(self.containers)
        for text, container, linked, furniture in self.blocks:
            good[container] += 0 if furniture else len(text) - linked
            other[container] += len(text) if furniture else linked
        for k in range(len(self.containers) - 1, 0, -1):
            good[self.containers[k][1]] += good[k]
            other[self.containers[k][1]] += other[k]
        out, depth = [], []
        for (step, parent, _), a, b in zip(self.containers, good, other, strict=True):
            depth.append(depth[parent] + 1 if parent >= 0 else -1)
            last = step.partition(".")[0]
            share = a / max(good[0], 1) * a / max(a + b, 1)
            out.append(share * (1 + 0.15 * (last in ("article", "main")) - 0.1 * (last in ("body", "")) + 0.02 * max(0, min(depth[-1], 5))))
        return out

    def text(self, path: str | None) -> str:
        """The blocks in containers on the path, by lines, or in the least container around
        all running text where those lack any of it. Furniture is in neither."""
        held = [k for text, k, linked, furniture in self.blocks if not furniture and linked < len(text)]
        if not held:
            return ""
        chosen = self._on(path) if path else set()
        inside = [False] * len(self.containers)
        for k, (_, parent, _) in enumerate(self.containers):
            inside[k] = k in chosen or (k > 0 and inside[parent])
        if not all(inside[k] for k in held):
            top = self._ancestor(held)
            for k, (_, parent, _) in enumerate(self.containers):
                inside[k] = k == top or (k > 0 and inside[parent])
        return "\n".join(text for text, container, _, furniture in self.blocks if inside[container] and not furniture)

    def _on(self, path: str) -> set[int]:
        last = path.rpartition(">")[2]
        return {k for k, (step, _, _) in enumerate(self.containers) if k and step == last and self.path(k) == path}

    def _ancestor(self, held: list[int]) -> int:
        """The least container that holds all of these; parents come before children."""
        some = set(held)
        last_first = [-k for k in some]
        heapq.heapify(last_first)
        while len(some) > 1:
            last = -heapq.heappop(last_first)
            some.remove(last)
            parent = self.containers[last][1]
            if parent not in some:
                some.add(parent)
                heapq.heappush(last_first, -parent)
        return some.pop()


def _vote(batches):
    sums: dict[tuple[str, str], list[float]] = defaultdict(lambda: [0.0, 0])
    held = 0
    for batch in batches:
        for rows in slices(batch, 1):
            for host, source in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                page = Page(source)
                best: dict[str, float] = {}
                for k, score in enumerate(page.scores()):
                    if k and score > 0:
                        path = page.path(k)
                        best[path] = max(score, best.get(path, 0))
                for path, score in best.items():
                    if (host, path) not in sums:
                        held += len(host) + len(path) + 100
                    own = sums[host, path]
                    own[0] += round(score * 1000)
                    own[1] += 1
                if held > VOTES_HELD:
                    yield _as_batch(sums)
                    sums.clear()
                    held = 0
    yield _as_batch(sums)


def _as_batch(sums: dict) -> pa.RecordBatch:
    hosts, paths = [k[0] for k in sums], [k[1] for k in sums]
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array([int(v[0]) for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.int64())], names=["host", "path", "votes", "n_pages"])


def host_of(url):
    """Host of a URL in lower case, without user and port; empty if it has none."""
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(found, F.lit(""))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path: for each host the path with the most votes; ties go to the path that
    is last by name. Pages whose URL has no host have no vote."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).where("host != '' and html is not null")
    votes = rows.mapInArrow(_vote, "host string, path string, votes long, n_pages long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max(F.struct("votes", "path"))["path"].alias("path"))


def _extract(batches):
    for batch in batches:
        for rows in slices(batch, 2):
            texts = [Page(source or "").text(path) for source, path in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    Blocks are in page order, one to a line, with white space inside each as one blank
    and character references decoded. A null html is an empty page and gives an empty
    text, as does one without running text; a null url, or one with no host, leaves the
    page to the least container around its running text. Repeated rows give repeated rows; null ids stay;
    other columns take no part.
    """
    work = Work(pages.sparkSession, "pages")
    winners = work.table(winning_paths(pages, url_col, html_col), "winners")
    held = winners.select(F.sum(F.octet_length("host") + F.octet_length("path") + 64)).first()[0] or 0
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host_of(F.col(url_col)).alias("host"))
    if held <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        joined = rows.withColumn("salt", salt(F.col("page_id"))).join(salted(winners), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
