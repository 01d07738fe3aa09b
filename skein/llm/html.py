"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: tags and text runs, each told apart by the path of open elements
with their classes. Over the pages of one host, a token's occurrence vector says how often it occurs
on each page; it is held as two sums of page hashes times counts, so it adds up in grouped sums and
is never gathered. Tokens with equal vectors are an equivalence class.

1. Skeleton: of the classes that stand at most once on a page and on `MIN_SHARE` of the pages at
   least, the one with most tokens on most pages, ordered by mean place. Text runs belong to it, and
   to other classes, only where they are on nearly all of `OWN_PAGES` pages or more.
2. Gaps: each page's skeleton tokens, where they stand in that order, cut the page into gaps. All
   other tokens get a new role, their gap and their path, and vectors anew. Classes of them with
   `MIN_TOKENS` tokens whose first and last places have one order are valid, and nested in the gap;
   their containers hold one another by their paths, so classes nest within classes.
3. Slots: the text runs that no valid class holds. Each adds its characters to all containers it
   stands in (a container of the skeleton by its path, any other by gap and path).
4. Article: from the whole page down, the container that holds `DOMINANT` of what the one above it
   holds. If an article element is around it, that one. Of the containers above, direct headings and
   paragraphs are kept too. Containers whose slots are nearly all links, on `MIN_SHARE` of the pages,
   are menus. Elements of other purpose (nav, footer, aside, form, ...) and containers marked as
   adverts, comments and the like are no part of it; headings, paragraphs and inline elements are
   never dropped for their marks.

A host of fewer than `MIN_PAGES` pages, and a page on which the skeleton's tokens do not stand in
order, have no template: step 4 is then made on the page alone. Where the template's words outweigh
the slots of a host `MIRRORED` times, its pages are copies of one: no words are taken for the template's.

Null, empty or textless html: empty text. Null url or one without host: the pages without host are
one host. Empty table: no rows. Very long pages are read whole. Repeated rows are judged alike and
count as pages. Ties of equal characters go to the lower hash. Extra columns stay; names that the
plan needs are chosen so that they do not clash. Markup that is broken off, unclosed or wrongly nested is repaired as browsers do
in outline: blocks close open paragraphs, an end tag closes all that is open within it.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import free_name, ship, written

MIN_PAGES = 3
#: A class is valid with so many tokens, on at least this share of the host's pages.
MIN_TOKENS, MIN_SHARE = 2, 0.5
#: Words are the template's own on at least so many pages and this share: a few mirrored articles are no template.
OWN_PAGES, OWN_SHARE = 8, 0.9
#: The share of its parent's slots at which a container is gone into; the share of links that makes a menu.
DOMINANT, LINKED, MIRRORED = 0.6, 0.9, 4
#: Bytes of all hosts' templates up to which they are broadcast; beyond, they are joined by shuffle.
MOST_BROADCAST = 8 << 20
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
#: Attributes that tell an element's role.
TOLD_BY = frozenset("class id role itemprop hidden style aria-hidden".split())
#: Longer attributes are parsed each time, not remembered.
MOST_KEPT = 400
_WORD = re.compile(r"[a-z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math select title xmp noembed noframes object canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
#: Elements that may hold an article or what is none; all others are parts of running text.
CONTAINER = frozenset("address article aside body center details dialog dir div dl fieldset figure footer form header html main menu nav ol section table ul".split())
HEADINGS, PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split()), frozenset("p blockquote pre".split())
OUT = frozenset("nav footer aside form head button dialog menu search fieldset input label".split())
#: Words in classes, ids and roles of containers that are not the article.
OUT_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup sidebar aside widget widgets menu menus nav navbar navigation navigational breadcrumb breadcrumbs footer foot masthead comment comments commentlist disqus replies respond share sharing social related recommended recommendations popup modal overlay login toolbar pagination pager skip search complementary contentinfo advertisements".split())
#: A mark counts only if it consists of those and these.
SIDE_WORDS = frozenset("area article bar block bottom box buttons col column container content desktop fixed global inline inner item items left links list main mobile outer page panel post posts primary region right row secondary section site slot sticky stories top unit wrap wrapper zone".split())
HEAD_WORDS = frozenset("header head topbar".split())
ARTICLE_WORDS = frozenset({"articlebody", "article"})
#: Elements an opening tag closes, if they are the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Flags of a token, above its characters. Kinds: 0 open, 1 close, 2 text, 3 break.
KIND, SIDE, LINK, HOLDS, ARTICLE, HEAD, TOP, HEADING, SHIFT = 3, 4, 8, 16, 32, 64, 128, 256, 9
ROOT = 0


@lru_cache(4096)
def _role(tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
    """The element's role, and whether it is out, a header, an article."""
    marks, hidden = [], False
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        if (name := name.lower()) not in TOLD_BY:
            continue
        value = (a or b or c).lower()
        if name == "style":
            hidden |= "display:none" in value.replace(" ", "")
        elif name == "hidden" or name == "aria-hidden":
            hidden |= name == "hidden" or value == "true"
        else:
            marks += [(name, w) for w in value.split()]
    holds = tag in CONTAINER and tag not in ("html", "body", "article", "main")
    parts = [set(_WORD.findall(w)) for _, w in marks]
    out = tag in OUT or hidden or (holds and any(p & OUT_WORDS and p <= OUT_WORDS | SIDE_WORDS for p in parts))
    article = tag == "article" or any(n in ("role", "itemprop") and w in ARTICLE_WORDS for n, w in marks)
    head = tag == "header" or (tag in ("div", "section") and any(p & HEAD_WORDS for p in parts))
    return ".".join([tag, *sorted(w for _, w in marks if not any(c.isdigit() for c in w))]), out, head, article


def _hash(x: bytes) -> int:
    return xxhash.xxh3_64_intdigest(x) >> 1 | 1


@lru_cache(1 << 16)
def _path(parent: int, name: str) -> int:
    return _hash(b"%d>%s" % (parent, name.encode()))


class Page:
    """Tokens of one page in order: (flags, hash, text). A path is one hash however deep it is."""

    def __init__(self, html: str):
        self.tokens: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int, int]] = []  # tag, path, flags
        at, n, add = 0, len(html), self.tokens.append
        path, flags = ROOT, 0

        def run(text: str) -> None:
            text = _html.unescape(text) if "&" in text else text
            words = " ".join(text.split())
            add((2 | flags & (SIDE | LINK) | len(words) << SHIFT, _hash(b"%d\0%s" % (path, words.encode("utf-8", "surrogatepass"))) if words else 0, text))

        def leave(to: int) -> None:
            nonlocal path, flags
            for tag, p, f in reversed(stack[to:]):
                add((1 | f & ~KIND, p ^ 2, ""))
                if tag in BLOCK:
                    add((3, 0, ""))
            del stack[to:]
            path, flags = stack[-1][1:] if stack else (ROOT, 0)

        while at < n:
            m = _TOKEN.search(html, at)
            if not m:
                run(html[at:])
                break
            if m.start() > at:
                run(html[at : m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                if m[0].startswith("<![CDATA["):
                    run(_html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if m[1]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        leave(i)
                        break
                else:
                    if tag in BLOCK:
                        add((3, 0, ""))
                continue
            if tag in BLOCK:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in (CLOSES.get(tag) or ()) or stack[i][0] == "p":
                        leave(i)
                        break
                    if stack[i][0] in BLOCK:
                        break
                add((3, 0, ""))
            attrs = m[3]
            name, out, head, article = (_role if len(attrs) < MOST_KEPT else _role.__wrapped__)(tag, attrs)
            own = _path(path, name)
            if tag in RAW:
                if attrs.endswith("/") and tag in ("svg", "math"):
                    continue
                end = re.compile(f"</{tag}\\s*>", re.I).search(html, at)
                at = end.end() if end else n
                add((0, own, ""))
                add((1, own ^ 2, ""))
                continue
            if tag in VOID:
                add((0, own, " "))
                add((1, own ^ 2, ""))
                if tag in BLOCK:
                    add((3, 0, ""))
                continue
            if attrs.endswith("/") and tag not in BLOCK:
                continue
            now = flags & (SIDE | LINK)
            if out:
                now |= SIDE
            if tag == "a":
                now |= LINK
            if tag in CONTAINER:
                now |= HOLDS
            now |= flags & ARTICLE | (ARTICLE if article else 0)
            if head and not now & ARTICLE:
                now |= HEAD
            if tag in HEADINGS:
                now |= TOP | HEADING
            elif tag in PARAGRAPHS:
                now |= TOP
            path, flags = own, now
            stack.append((tag, path, flags))
            add((now, path, ""))
        leave(0)

    def packed(self) -> tuple[bytes, bytes]:
        """Hashes and flags of the tags and words, as arrays of 64 bits."""
        a = np.array([(h, f) for f, h, _ in self.tokens if h], dtype=np.int64).reshape(-1, 2)
        return a[:, 0].tobytes(), a[:, 1].tobytes()


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def sequences(pages: DataFrame, page_key: str, host: str, html: str) -> DataFrame:
    """host, page_key, and the page's tokens (hashes, flags): pages are parsed once for all statistics."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Page(x.as_py() or "").packed() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a for a, _ in made], pa.binary()), pa.array([b for _, b in made], pa.binary())], names=["host", "page_key", "hashes", "flags"])

    return pages.select(host, page_key, html).mapInArrow(read, "host string, page_key long, hashes binary, flags binary")


SUMS = ("s1", "s2", "pages", "occurs", "first", "last")
_SUMS = ", ".join(f"{c} long" for c in SUMS)


def _sums(host: np.ndarray, page: np.ndarray, token: np.ndarray, place: np.ndarray, mix: np.ndarray) -> dict[str, np.ndarray]:
    """Per (host, token): the occurrence vector's two sums, its pages and occurrences, and sums of its first and last places. host and page are numbers."""
    order = np.lexsort((place, page, token, host))
    host, page, token, place = host[order], page[order], token[order], place[order]
    new = np.r_[True, (np.diff(page) != 0) | (np.diff(token) != 0) | (np.diff(host) != 0)]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(page)])
    first, last, host, page, token = place[at], place[at + count - 1], host[at], page[at], token[at]
    starts = np.flatnonzero(np.r_[True, (np.diff(token) != 0) | (np.diff(host) != 0)])
    m = mix[page]
    add = lambda x: np.add.reduceat(x, starts)
    return {"host": host[starts], "token": token[starts], "s1": add((m & 0x7FFFFFFF) * count & 0xFFFFFFFF), "s2": add((m >> 31 & 0x7FFFFFFF) * count & 0xFFFFFFFF), "pages": add(np.ones(len(page), np.int64)), "occurs": add(count), "first": add(first), "last": add(last)}


def _rows(batch: pa.RecordBatch) -> tuple[list, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    mixes = np.array([_hash(k.to_bytes(8, "little", signed=True)) for k in batch["page_key"].to_pylist()], dtype=np.int64)
    return batch["host"].to_pylist(), mixes, [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)) for a, b in zip(batch["hashes"].to_pylist(), batch["flags"].to_pylist(), strict=True)]


def profiles(read: DataFrame) -> DataFrame:
    """Per host and token: its sums. Token 0 is the page itself; text has words = true. Sums are made within each batch first."""

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, mixes, pages = _rows(batch)
            if not hosts:
                continue
            names, host = np.unique(np.array(hosts, dtype=object), return_inverse=True)
            tokens = [np.r_[0, a] for a, _ in pages]
            page = np.repeat(np.arange(len(pages)), [len(x) for x in tokens])
            token = np.concatenate(tokens)
            words = np.concatenate([np.r_[0, (b & KIND == 2).astype(np.int64)] for _, b in pages])
            s = _sums(host[page], page, token, np.concatenate([np.arange(len(x)) for x in tokens]), mixes)
            word = np.zeros(len(s["token"]), bool)
            known = np.unique(token[words == 1])
            word[np.isin(s["token"], known)] = True
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in s["host"]], pa.string()), pa.array(s["token"]), pa.array(word), *(pa.array(s[c].astype(np.int64)) for c in SUMS)], names=["host", "token", "words", *SUMS])

    made = read.mapInArrow(profile, f"host string, token long, words boolean, {_SUMS}")
    return made.groupBy("host", "token").agg(F.bool_or("words").alias("words"), *(F.sum(c).alias(c) for c in SUMS))


def _of_hosts(profile: DataFrame) -> DataFrame:
    return profile.filter("token = 0").select("host", F.col("pages").alias("n")).filter(F.col("n") >= MIN_PAGES)


def _common(profile: DataFrame, hosts: DataFrame) -> DataFrame:
    """The tokens on enough of a host's pages: at most 1/MIN_SHARE times as many as an average page has."""
    enough = F.when(F.col("words"), (F.col("n") >= OWN_PAGES) & (F.col("pages") >= OWN_SHARE * F.col("n"))).otherwise(F.col("pages") >= MIN_SHARE * F.col("n"))
    small = hosts.count() * 64 <= MOST_BROADCAST
    return profile.filter("token <> 0").join(F.broadcast(hosts) if small else hosts, "host").filter(enough)


def skeletons(profile: DataFrame, hosts: DataFrame) -> DataFrame:
    """host, n, skeleton (hashes in order), common and common_words (other hashes, and whether they are words): one row per host with a skeleton."""
    tokens = written(_common(profile, hosts), "common")
    once = tokens.filter("occurs = pages").groupBy("host", "s1", "s2").agg(F.count("*").alias("size"), F.first("pages").alias("pages")).filter(F.col("size") >= MIN_TOKENS)
    best = written(once.groupBy("host").agg(F.max(F.struct((F.col("size") * F.col("pages")).alias("held"), "s1", "s2")).alias("b")).select("host", F.col("b.s1").alias("b1"), F.col("b.s2").alias("b2")), "best")
    small = best.count() * 64 <= MOST_BROADCAST
    joined = tokens.join(F.broadcast(best) if small else best, "host")
    mine = (F.col("s1") == F.col("b1")) & (F.col("s2") == F.col("b2")) & (F.col("occurs") == F.col("pages"))
    order = F.array_sort(F.collect_list(F.when(mine, F.struct((F.col("first") / F.col("pages")).alias("place"), "token"))))
    rest = F.collect_list(F.when(~mine, F.struct("token", "words")))
    grouped = joined.groupBy("host").agg(F.first("n").alias("n"), order.alias("o"), rest.alias("r"))
    return grouped.select("host", "n", F.col("o.token").alias("skeleton"), F.col("r.token").alias("common"), F.col("r.words").alias("common_words"))


def _gaps(hashes: np.ndarray, skeleton: np.ndarray) -> np.ndarray | None:
    """The gap of each token; None where the skeleton's tokens do not stand in order. A page may lack some: they have no part then."""
    order = np.argsort(skeleton)
    at = np.searchsorted(skeleton[order], hashes)
    at[at == len(skeleton)] = 0
    hit = np.flatnonzero(skeleton[order][at] == hashes)
    rank = order[at[hit]]
    if len(rank) * 2 < len(skeleton) or (np.diff(rank) <= 0).any():
        return None
    gap = np.zeros(len(hashes), np.int64)
    gap[hit] = rank + 1
    return np.maximum.accumulate(gap)


def _dealt(gap: int, path: int) -> int:
    return _hash(b"%d|%d" % (gap, path)) if path else ROOT


def containers(hashes: list[int], flags: list[int], gaps: list[int] | None, skeleton: set[int], own: set[int]) -> dict[int, list[int]]:
    """Per container of a page: characters of slots, of links among them, of own words, its parent, and whether it is an article."""
    found: dict[int, list[int]] = {ROOT: [0, 0, 0, ROOT, 0]}
    stack, head = [[ROOT, 0, 0, 0]], 0

    def leave() -> None:  # what a container holds counts for the one around it too
        name, *sums = stack.pop()
        for j, x in enumerate(sums):
            found[name][j] += x
            if stack:
                stack[-1][j + 1] += x

    for i, (h, f) in enumerate(zip(hashes, flags, strict=True)):
        kind = f & KIND
        if kind == 0 and f & HOLDS:
            name = h if gaps is None or h in skeleton else _dealt(gaps[i], h)
            head += f & HEAD != 0
            found.setdefault(name, [0, 0, 0, stack[-1][0], f & ARTICLE])
            stack.append([name, 0, 0, 0])
        elif kind == 1 and f & HOLDS:
            head -= f & HEAD != 0
            leave()
        elif kind == 2 and not f & SIDE and not head:
            mine = h in own
            stack[-1][3 if mine else 1] += f >> SHIFT
            if f & LINK and not mine:
                stack[-1][2] += f >> SHIFT
    while stack:
        leave()
    return found


def article(found: dict[int, list]) -> int:
    """The container whose slots are the article."""
    inside: dict[int, list[int]] = {}
    for name, c in found.items():
        if name != ROOT:
            inside.setdefault(c[3], []).append(name)
    weight = {name: max(0, c[0] - c[1]) for name, c in found.items()}
    if sum(c[2] for name, c in found.items() if name == ROOT) > MIRRORED * found[ROOT][0]:
        weight = {name: max(0, c[0] - c[1] + c[2]) for name, c in found.items()}
    now = ROOT
    while kids := [(weight[k], -k) for k in inside.get(now, ()) if weight[k]]:
        most, k = max(kids)
        if most < DOMINANT * weight[now]:
            break
        now = -k
    up, seen = now, set()
    while up != ROOT and up in found and up not in seen:
        seen.add(up)
        if found[up][4] and not (found[up][3] in found and found[found[up][3]][4]):
            return up
        up = found[up][3]
    return now


def gap_sums(read: DataFrame, named: DataFrame, small: bool) -> DataFrame:
    """Per host: sums of the common tokens by gap (kind 0), and of containers by gap (kind 1)."""
    columns = ["host", "kind", "token", "path", "gap", "words", *SUMS, "parent", "article"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            hosts, mixes, pages = _rows(batch)
            rows: list[tuple] = []
            held: dict[tuple[str, int], list[int]] = {}
            by: dict[str, list] = {}
            for i, (h, (a, b)) in enumerate(zip(hosts, pages, strict=True)):
                if h not in known:
                    skeleton = np.array(batch["skeleton"][i].as_py(), np.int64)
                    common, words = batch["common"][i].as_py() or [], batch["common_words"][i].as_py() or []
                    known[h] = skeleton, np.array(sorted(common), np.int64), {t for t, w in zip(common, words, strict=True) if w}
                skeleton, common, own = known[h]
                gap = _gaps(a, skeleton)
                if gap is None:
                    continue
                skeleton = set(skeleton.tolist())
                for name, c in containers(a.tolist(), b.tolist(), gap.tolist(), skeleton, own | skeleton).items():
                    s = held.setdefault((h, name), [0, 0, 0, 0, c[3], c[4]])
                    for j in range(3):
                        s[j] += c[j]
                    s[3] += 1
                at = np.flatnonzero(np.isin(a, common))
                by.setdefault(h, []).append((i, a[at], gap[at], at, b[at] & KIND == 2))
            for h, parts in by.items():
                page = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
                if not len(page):
                    continue
                token, gap, place, word = (np.concatenate([p[j] for p in parts]) for j in range(1, 5))
                keys, index = np.unique(np.stack([gap, token]), axis=1, return_inverse=True)
                s = _sums(np.zeros(len(page), np.int64), page.astype(np.int64), index.ravel(), place, mixes)
                is_word = np.zeros(keys.shape[1], bool)
                is_word[index.ravel()[word]] = True
                for j, t in enumerate(s["token"].tolist()):
                    rows.append((h, 0, _dealt(int(keys[0, t]), int(keys[1, t])), int(keys[1, t]), int(keys[0, t]), bool(is_word[t]), *(int(s[c][j]) for c in SUMS), 0, 0))
            for (h, name), s in held.items():
                rows.append((h, 1, name, name, 0, False, s[0], s[1], s[3], s[2], 0, 0, s[4], s[5]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=columns)

    joined = read.join(F.broadcast(named) if small else named, "host")
    out = joined.select("host", "page_key", "hashes", "flags", "skeleton", "common", "common_words").mapInArrow(made, f"host string, kind long, token long, path long, gap long, words boolean, {_SUMS}, parent long, article long")
    return out.groupBy("host", "kind", "token").agg(F.max("path").alias("path"), F.max("gap").alias("gap"), F.bool_or("words").alias("words"), *(F.sum(c).alias(c) for c in SUMS), F.min("parent").alias("parent"), F.max("article").alias("article"))


TEMPLATE = "host string, region long, own array<long>, menus array<long>, classes array<struct<gap:long,pages:long,tokens:array<long>>>"
_TEMPLATE = pa.schema([("host", pa.string()), ("region", pa.int64()), ("own", pa.list_(pa.int64())), ("menus", pa.list_(pa.int64())), ("classes", pa.list_(pa.struct([("gap", pa.int64()), ("pages", pa.int64()), ("tokens", pa.list_(pa.int64()))])))])


def templates(sums: DataFrame, named: DataFrame) -> DataFrame:
    """One row per host: the article's container, the template's own words, menus, the skeleton, and the nested classes with their gaps.

    What is gathered per host are containers and tokens on a share of its pages: as many as a page has, times a constant.
    """
    small = named.count() * 64 <= MOST_BROADCAST
    of = named.select("host", "n")
    enough = sums.join(F.broadcast(of) if small else of, "host").filter(F.col("pages") >= F.col("n") * F.when(F.col("token") == ROOT, 0).otherwise(MIN_SHARE))

    def build(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        n = rows[0]["n"]
        found = {r["token"]: [r["s1"], r["s2"], r["occurs"], r["parent"], r["article"]] for r in rows if r["kind"] == 1}
        found.setdefault(ROOT, [0, 0, 0, ROOT, 0])
        at = {r["token"]: r["pages"] for r in rows if r["kind"] == 1}
        region = article(found)
        above, up = set(), region
        while up != ROOT and up in found and up not in above:
            above.add(up)
            up = found[up][3]
        menus = [k for k, c in found.items() if k != ROOT and k not in above and c[0] and c[1] >= LINKED * c[0] and at[k] >= MIN_SHARE * n]
        groups: dict[tuple, list] = {}
        for r in rows:
            if r["kind"] == 0:
                groups.setdefault((r["gap"], r["s1"], r["s2"], r["pages"]), []).append(r)
        classes, own = [], []
        for (gap, _, _, pages), c in sorted(groups.items()):
            c.sort(key=lambda r: (r["first"], r["token"]))
            # one class if its tokens come in one order, at their first and their last places
            ends = [r["last"] for r in c]
            if len(c) < MIN_TOKENS or ends != sorted(ends):
                continue
            classes.append({"gap": gap, "pages": pages, "tokens": [r["path"] for r in c]})
            if pages >= OWN_SHARE * n and n >= OWN_PAGES:
                own += [r["token"] for r in c if r["words"]]
        if found[ROOT][2] > MIRRORED * found[ROOT][0]:
            own = None
        return pa.Table.from_pylist([{"host": rows[0]["host"], "region": region, "own": own, "menus": menus, "classes": classes}], schema=_TEMPLATE)

    return enough.groupBy("host").applyInArrow(lambda t: build(t), TEMPLATE).join(named.select("host", "skeleton"), "host")


class Template:
    """What a page is read by."""

    def __init__(self, row: dict):
        self.skeleton = np.array(row["skeleton"], np.int64)
        self.tags = set(row["skeleton"])
        self.fixed = self.tags if row["own"] is not None else set()
        self.region, self.own, self.menus = row["region"], set(row["own"] or ()), set(row["menus"])


_WHOLE = frozenset({ROOT, top := _path(ROOT, "html"), _path(top, "body"), _path(ROOT, "body")})


def extract(html: str | None, template: Template | None = None) -> str:
    """The article's slots of one page."""
    if not html:
        return ""
    page = Page(html)
    kept = [(h, f) for f, h, _ in page.tokens if h]
    if not kept:
        return ""
    hashes, flags = [h for h, _ in kept], [f for _, f in kept]
    gaps = _gaps(np.array(hashes, np.int64), template.skeleton) if template else None
    tags, menus, fixed, own = set(), set(), set(), set()
    if gaps is not None:
        gaps, tags, menus, fixed, own = gaps.tolist(), template.tags, template.menus, template.fixed, template.own
    held = containers(hashes, flags, gaps, tags, fixed)
    region = template.region if gaps is not None and template.region in held else article(held)
    blocks, now = [], []

    def close() -> None:
        if now and (text := " ".join("".join(now).split())):
            blocks.append(text)
        now.clear()

    stack = [(ROOT, False)]  # open containers, and whether they are out
    inside, i, begin, around = int(region == ROOT), -1, None, set()
    loose: list[tuple[int, int, bool, int]] = []  # blocks outside of the region: from, to, whether a heading, the container around
    top = mark = 0
    for f, h, text in page.tokens:
        kind = f & KIND
        if kind == 3:
            close()
            continue
        i += h != 0
        if kind == 0:
            if f & HOLDS:
                name = h if gaps is None or h in tags else _dealt(gaps[i], h)
                bad = stack[-1][1] or f & SIDE != 0 or name in menus or (f & HEAD != 0 and (region in _WHOLE or not inside))
                if name == region and not bad:
                    close()
                    around |= {s for s, _ in stack}
                    begin = len(blocks) if begin is None else begin
                    inside += 1
                stack.append((name, bad))
            elif f & TOP and not inside:
                close()
                top += 1
                mark = len(blocks) if top == 1 else mark
            elif text and not stack[-1][1] and not f & SIDE:
                now.append(text)
        elif kind == 1:
            if f & HOLDS:
                name, bad = stack.pop()
                if name == region and not bad:
                    close()
                    inside -= 1
            elif f & TOP and top:
                close()
                top -= 1
                if not top and len(blocks) > mark and (begin is None or begin < mark):
                    loose.append((mark, len(blocks), f & HEADING != 0, stack[-1][0]))
        elif not stack[-1][1] and not f & SIDE and (inside or top) and h not in fixed and not (own and h and _dealt(gaps[i], h) in own):
            now.append(text)
    close()
    drop = set()
    for start, end, heading, parent in loose:
        if parent not in around or (parent in _WHOLE and not (heading and start < begin)):
            drop.update(range(start, end))
    return "\n\n".join(b for k, b in enumerate(blocks) if k not in drop)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "main_text") -> DataFrame:
    """pages with one more column: the main text."""
    spark = pages.sparkSession
    ship(spark)
    host, key, t = free_name(pages, "host"), free_name(pages, "page_key"), free_name(pages, "template")
    keyed = pages.withColumn(host, host_of(F.col(url))).withColumn(key, F.xxhash64(url, html))
    read = written(sequences(keyed, key, host, html), "sequences")
    profile = written(profiles(read), "profiles")
    named = written(skeletons(profile, _of_hosts(profile)), "skeletons")
    # a template has as many tokens as a page, times a constant; the sum over hosts decides how it is sent
    size = lambda df, *lists: df.agg(F.coalesce(F.sum(sum((F.size(c) for c in lists), F.lit(8)) * 9), F.lit(0))).first()[0]
    sums = written(gap_sums(read, named, size(named, "skeleton", "common") <= MOST_BROADCAST), "gaps")
    found = written(templates(sums, named), "templates").select("host", "region", "own", "menus", "skeleton")
    small = size(found, "skeleton", "own", "menus") <= MOST_BROADCAST
    found = found.select(F.col("host").alias(host), F.struct("region", "own", "menus", "skeleton").alias(t))

    @F.arrow_udf("string")
    def slots(hosts: pa.Array, htmls: pa.Array, of_hosts: pa.Array) -> pa.Array:
        known: dict[str, Template | None] = {}
        result = []
        for h, x, i in zip(hosts.to_pylist(), htmls, range(len(hosts)), strict=True):
            if h not in known:
                row = of_hosts[i].as_py()
                known[h] = Template(row) if row else None
            result.append(extract(x.as_py(), known[h]))
        return pa.array(result, pa.string())

    joined = keyed.join(F.broadcast(found) if small else found, host, "left")
    return joined.withColumn(out, slots(F.col(host), F.col(html), F.col(t))).drop(host, key, t)
