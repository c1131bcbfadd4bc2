"""Main text of web pages: markup rules and host suffix arrays.

Each page is cut into blocks of text, marked by where they stand: in an element that
never holds main text (menus, forms, adverts, ...), in the article, or elsewhere.
The token streams of a host's pages outside their articles are then concatenated,
and a suffix array over them finds the runs of ``RUN`` tokens or more that stand on
several distinct pages; ``n_repeated`` counts their words. Where a page has no article
element, its main text is its other blocks without what repeats as a whole block (of
``RUN`` words or more) or in a run of ``LONG`` tokens or more: shorter repeats are
phrases of the language.

Suffix arrays over the main texts themselves, articles included, find what no markup
tells: whole blocks and long runs that are common to the host. They are on more than
half of its distinct main texts, on ``FEW`` at least, and on most of these beside text
of the page's own (``OWN`` of its words or more), so that neither passages that some
articles share nor versions of one article count. They are cut from every page.

Suffixes are ranked by doubling up to ``RUN`` or ``LONG`` tokens: that already tells
which positions a repeated run covers. Hosts with many pages are dealt out to groups of
about ``PAGES`` pages with a suffix array each; the runs that a group holds in one
stream only are counted over the whole host by their hashes, so that the groups
don't change what repeats. What is common to a host is so in one of its groups at least;
these candidates are then counted over all its pages.

Defined cases: null html is empty text; a page without text has the empty string; a
null url is a host of its own; repeated pages (equal streams) count as one page when
runs are counted; a page without an article that the runs leave with less than ``LEFT``
of its words is a copy of others and loses only what is common to the host; a page that
is nothing else is kept whole; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_ROWS, small_side
from panelcast.session import stage

RUN = 4
LONG = 30
PAGES = 256
LEFT = 0.2
FEW = 4
OWN = 0.5

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|[^<]++|<",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript template iframe xmp svg annotation annotation-xml".split())
#: Elements that never hold main text; a page's header can hold the article's title only inside it.
NEVER = frozenset("nav footer aside form button select option label fieldset dialog menu head canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rt rp s samp small "
    "span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow msub msup msubsup mfrac msqrt semantics annotation annotation-xml".split()
)
#: Parts of class names and ids, and roles, of what is not main text. A name that says
#: what an element has, hides or lacks is none of them.
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isements?|ising)?|sponsor(?:ed|s)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|"
    r"notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|nav(?:bar|igation)?|menu|breadcrumbs?|"
    r"side-?bar|widgets?|footer|masthead|site-?header|page-?header|comments?|disqus|respond|share|sharing|social|related|"
    r"recommend(?:ed|ations)?|pagination|pager|search|toolbar|skip-?link|copyright|hidden)(?:$|[\s_-])",
    re.IGNORECASE,
)
MODIFIER = re.compile(r"(?:has|no|not|non|with|without|overflow|hide|show|toggle)[_-]", re.IGNORECASE)
#: What holds no main text even where an article stands in it.
NO_ARTICLE = re.compile(
    r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|nav\w*|menu|side-?bar|widgets?|footer|comments?|disqus|respond|related|recommend\w*)(?:$|[_-])",
    re.IGNORECASE,
)
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
MAIN_CLASS = re.compile(r"(?:^|\s)(?:article|post|entry|story)(?:[_-]?(?:body|content|text))?(?:$|\s)", re.IGNORECASE)

#: A shell is no main text, but an article buried in it is where the page has no other.
ARTICLE, MAIN, NAMED, OTHER, CHROME, SHELL, BURIED = range(7)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")


def _attributes(text: str) -> dict[str, str]:
    return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(text)}


def _names(a: dict[str, str]) -> list[str]:
    """Class names and the id, without modifiers."""
    return [n for n in (a.get("class", "") + " " + a.get("id", "")).split() if not MODIFIER.match(n)]


def _never(tag: str, attributes: str, inside: bool) -> int | None:
    """CHROME or SHELL for an element that holds no main text, else None."""
    if tag in NEVER or (tag == "header" and not inside):
        return CHROME
    if not attributes.strip() or tag in ("html", "body"):
        return None
    a = _attributes(attributes)
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", QUOTED.sub("", attributes), re.IGNORECASE) or "display:none" in a.get("style", "").replace(" ", ""):
        return CHROME
    if a.get("role", "").lower() in NOT_MAIN_ROLES or a.get("aria-hidden") == "true":
        return CHROME
    if tag in ("article", "main") and not re.search("comment", a.get("class", "") + a.get("id", ""), re.IGNORECASE):
        return None
    found = [n for n in _names(a) if NOT_MAIN.search(n)]
    if not found:
        return None
    return CHROME if any(NO_ARTICLE.search(n) for n in found) else SHELL


def blocks(html: str | None) -> list[tuple[int, str]]:
    """(place, text) of a page's blocks in page order; white space is one space."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_tags: list[tuple[str, int | None]] = []  # containers, with the place they give
    places = [OTHER]
    html = html or ""
    lower: str | None = None
    at, end = 0, len(html)

    def flush() -> None:
        if text:
            words = "".join(text).split()
            if words:
                out.append((places[-1], " ".join(words)))
            text.clear()

    while at < end:
        m = MARKUP.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(unescape(piece) if "&" in piece else piece)
            continue
        tag = tag.lower()
        if tag in RAW and not m[1]:
            close = re.compile(f"</{re.escape(tag)}\\b[^>]*>", re.IGNORECASE).search(html, at)
            if not m[3].rstrip().endswith("/"):
                at = close.end() if close else (end if tag in ("script", "style") else at)
            if tag not in INLINE:
                flush()
            continue
        inline = tag in INLINE
        if inline and (m[1] or not m[3].strip()) and not (open_tags and any(t in INLINE for t, _ in open_tags)):
            continue
        if not inline:
            flush()
        if tag in VOID or m[3].rstrip().endswith("/"):
            continue
        if m[1] and inline:
            # Closes the innermost of that name in its container; one that gives a
            # place ends there even where containers in it are still open.
            for i in range(len(open_tags) - 1, -1, -1):
                name, given = open_tags[i]
                if name == tag and (given is not None or all(t in INLINE for t, _ in open_tags[i:])):
                    closed = [p for t, p in open_tags[i:] if t in INLINE and p is not None]
                    if closed:
                        flush()
                    for _ in closed:
                        places.pop()
                    open_tags[i:] = [o for o in open_tags[i:] if o[0] not in INLINE]
                    break
                if name not in INLINE and (given is not None or places[-1] not in (CHROME, SHELL)):
                    break
            continue
        if m[1]:
            # Closes the innermost open container of that name.
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i][0] == tag:
                    if any(p is not None for _, p in open_tags[i:]):
                        flush()
                    for _ in range(sum(p is not None for _, p in open_tags[i:])):
                        places.pop()
                    del open_tags[i:]
                    break
            continue
        place = None
        if places[-1] == SHELL and tag in ("article", "main"):
            place = BURIED if _never(tag, m[3], True) is None else None
        elif places[-1] not in (CHROME, SHELL):
            kind = _never(tag, m[3], places[-1] in (ARTICLE, NAMED, BURIED))
            if kind is not None:
                if lower is None:
                    lower = html.lower()
                # An element that is never closed would swallow the page.
                place = kind if lower.find(f"</{tag}", at) >= 0 else None
            elif places[-1] == BURIED:
                pass
            elif tag == "article":
                place = ARTICLE
            elif tag == "main" and places[-1] == OTHER:
                place = MAIN
            elif places[-1] in (OTHER, MAIN) and m[3].strip():
                a = _attributes(m[3])
                # A link or span of such a class names an article, it does not hold it.
                named = not inline and (MAIN_CLASS.search(a.get("class", "")) or MAIN_CLASS.search(a.get("id", "")))
                if named or a.get("itemprop", "").lower() == "articlebody":
                    place = NAMED
        if place is not None:
            flush()
            places.append(place)
        if tag not in ("p", "li", "tr", "td", "th", "dt", "dd") or place is not None:
            open_tags.append((tag, place))
    flush()
    return out


def article_blocks(found: list[tuple[int, str]]) -> list[str] | None:
    """The blocks of the article, or of what stands for one; None without."""
    for place in (ARTICLE, NAMED, MAIN, BURIED):
        text = [t for p, t in found if p == place]
        if text:
            return text
    return None


def article(found: list[tuple[int, str]]) -> str | None:
    """The text of the article, or of what stands for one; None without."""
    text = article_blocks(found)
    return None if text is None else " ".join(text)


def _kinds(streams: list[np.ndarray]) -> np.ndarray:
    """Number of every stream among the distinct ones."""
    kinds: dict[bytes, int] = {}
    return np.array([kinds.setdefault(s.tobytes(), len(kinds)) for s in streams], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _steps(run: int) -> Iterator[tuple[int, int]]:
    """Lengths by which ranks of suffixes are extended up to ``run`` tokens."""
    size = 1
    while size < run:
        step = min(size, run - size)
        yield size, step
        size += step


def _salt(name: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(name))


def _run_hashes(tokens: np.ndarray, run: int, salt: np.uint64 | np.ndarray) -> np.ndarray:
    """Hash of the ``run`` tokens from every place."""
    h = _mixed(tokens ^ salt)
    for _, step in _steps(run):
        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + np.r_[h[step:], np.zeros(min(step, len(h)), np.uint64)])
    return h.view(np.int64)


class Runs:
    """Runs of ``run`` tokens in the streams of one group, and in how many distinct
    streams they are. A zero in a stream ends a block; no run goes across it."""

    def __init__(self, streams: list[np.ndarray], run: int, kinds: np.ndarray, salt: str = "") -> None:
        self.streams, self.run, self.salt = streams, run, salt
        self.tokens = np.concatenate([x for s in streams for x in (s, np.zeros(1, np.uint64))])
        page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
        kind = kinds[page]
        rank = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64)
        # No two ends are equal: no run goes across them.
        ends = np.flatnonzero(self.tokens == 0)
        rank += len(ends)
        rank[ends] = np.arange(len(ends))
        for _, step in _steps(run):
            after = np.r_[rank, np.full(step, -1)][step:] + 1
            rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
        order = np.lexsort((kind, rank))
        r, k = rank[order], kind[order]
        new = np.r_[True, r[1:] != r[:-1]]
        group = np.cumsum(new) - 1
        self.held = np.zeros(len(self.tokens), np.int64)
        self.held[order] = np.bincount(group[new | np.r_[True, k[1:] != k[:-1]]])[group]
        self.several = self.held > 1
        # A run that meets an end is shorter than asked for.
        at = np.arange(len(self.tokens))
        self.whole = ends[np.searchsorted(ends, at)] - at >= run
        self.first = np.zeros(len(self.tokens), bool)
        self.first[order[new]] = True
        self.page = page

    def keys(self) -> np.ndarray:
        return _run_hashes(self.tokens, self.run, _salt(self.salt))

    def covered(self, known: np.ndarray | None = None) -> list[np.ndarray]:
        """Per stream, which tokens stand in a run of two or more distinct streams,
        or in one of the ``known`` hashes."""
        starts = self.several
        if known is not None and len(known):
            starts = starts | np.isin(self.keys(), known)
        at = np.flatnonzero(starts & self.whole)
        n = len(self.tokens)
        covered = np.cumsum(np.bincount(at, minlength=n) - np.bincount(np.minimum(at + self.run, n - 1), minlength=n)) > 0
        out, lo = [], 0
        for s in self.streams:
            out.append(covered[lo : lo + len(s)])
            lo += len(s) + 1
        return out


def repeated(streams: list[np.ndarray], run: int = RUN) -> list[np.ndarray]:
    """Per stream, which tokens stand in a run of ``run`` tokens or more that is
    found in two or more different streams. Equal streams count as one; a zero in a
    stream ends a block, and no run goes across it."""
    if not streams or sum(map(len, streams)) == 0:
        return [np.zeros(len(s), bool) for s in streams]
    return Runs(streams, run, _kinds(streams)).covered()


def _hashes(text: list[str]) -> np.ndarray:
    """Tokens of blocks of text, with a zero after each block."""
    words = " \n ".join([*text, ""]).split(" ")[:-1]
    tokens = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    return np.where(tokens == _salt("\n"), np.uint64(0), tokens | np.uint64(1))


def _block_hashes(stream: np.ndarray, run: int) -> np.ndarray:
    """One token per block of a stream; zero for blocks of fewer than ``run`` words."""
    ends = np.flatnonzero(stream == 0)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    return np.array([xxhash.xxh3_64_intdigest(stream[i:j].tobytes()) | 1 if j - i >= run else 0 for i, j in zip(starts, ends)], np.uint64)


def _cut_runs(streams: list[np.ndarray], host: str, kinds: np.ndarray, run: int, long: int) -> tuple[Runs, Runs]:
    """What is cut from pages without an article: long runs, and whole blocks."""
    whole = [_block_hashes(s, run) for s in streams]
    return Runs(streams, long, kinds, f"{long} {host}"), Runs(whole, 1, kinds, f"block {host}")


def run_rows(streams: list[np.ndarray], host: str, run: int = RUN, long: int = LONG) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Every distinct run, long run and block of a group, as its key (a hash of host
    and run), and the hash of the stream that holds it, twice; the least and the
    greatest long stand for a run that several streams hold."""
    of = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in streams], np.uint64).view(np.int64)
    kinds, limits = _kinds(streams), np.iinfo(np.int64)
    for runs in (Runs(streams, run, kinds, f"{run} {host}"), *_cut_runs(streams, host, kinds, run, long)):
        at = np.flatnonzero(runs.first & runs.whole)
        held, several = of[runs.page[at]], runs.several[at]
        yield runs.keys()[at], np.where(several, limits.min, held), np.where(several, limits.max, held)


def passages(
    streams: list[np.ndarray], hosts: list[str], run: int = RUN, long: int = LONG
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every long run and every block of ``run`` words or more: the number of its
    stream, its key, its first word in the stream, and the word behind its last one."""
    tokens = np.concatenate(streams)
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    ends = np.flatnonzero(tokens == 0)
    block = np.searchsorted(ends, np.arange(len(tokens)))
    runs = np.flatnonzero(ends[block] - np.arange(len(tokens)) >= long)
    whole = _block_hashes(tokens, run)
    large = np.flatnonzero(whole)
    salts = {h: (_salt(f"{long} {h}"), _salt(f"block {h}")) for h in set(hosts)}
    of_runs, of_blocks = (np.array([salts[h][i] for h in hosts], np.uint64) for i in range(2))
    keys = np.r_[_run_hashes(tokens, long, of_runs[page])[runs], _run_hashes(whole, 1, of_blocks[page[ends]])[large]]
    # Places count words only: as many zeros as ended blocks stand before each.
    first = np.r_[runs - block[runs], np.r_[0, ends[:-1] + 1][large] - large]
    last = np.r_[runs - block[runs] + long, ends[large] - large]
    page = np.r_[page[runs], page[ends[large]]]
    before = np.cumsum([0, *((s > 0).sum() for s in streams)])[page]
    return page, keys, first - before, last - before


def _found(streams: list[np.ndarray], host: str, keys: np.ndarray, run: int, long: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Where streams hold one of the ``keys``, as numbers of stream and key, and per
    stream which of its words they cover."""
    page, key, first, last = passages(streams, [host] * len(streams), run, long)
    order = np.argsort(keys)
    at = np.minimum(np.searchsorted(keys, key, sorter=order), len(keys) - 1)
    here = keys[order[at]] == key
    page, words = page[here], np.cumsum([0, *((s > 0).sum() for s in streams)])
    starts, stops = (np.bincount(x[here] + words[page], minlength=words[-1] + 1) for x in (first, last))
    return page, order[at[here]], np.split(np.cumsum(starts - stops)[:-1] > 0, words[1:-1])


def candidates(streams: list[np.ndarray], host: str, run: int = RUN, long: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the passages that more than half of the streams (distinct ones) hold,
    and by how many they are held."""
    n, cuts = len(streams), np.cumsum([len(s) for s in streams])
    tokens = np.concatenate(streams)
    # Each word of such a run is in more than half of the streams itself.
    word = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    held = np.unique(word * n + np.repeat(np.arange(n), np.diff(cuts, prepend=0))) // n
    usual = (np.bincount(held) * 2 > n)[word] & (tokens > 0)
    breaks = np.r_[-1, np.flatnonzero(~usual), len(tokens)]
    wide = usual & ((np.diff(breaks) > long)[np.cumsum(~usual)])
    kept = wide | np.r_[False, wide[:-1]]
    near = [x[k] for x, k in zip(np.split(np.where(wide, tokens, np.uint64(0)), cuts[:-1]), np.split(kept, cuts[:-1]))]
    blocks_of = [_block_hashes(s, run) for s in streams]
    found = []
    for runs in (Runs(near, long, np.arange(n), f"{long} {host}"), Runs(blocks_of, 1, np.arange(n), f"block {host}")):
        at = np.flatnonzero(runs.first & runs.whole & (runs.held * 2 > n))
        found.append((runs.keys()[at], runs.held[at]))
    return np.concatenate([k for k, _ in found]), np.concatenate([h for _, h in found])


def common_passages(streams: list[np.ndarray], host: str, run: int = RUN, long: int = LONG) -> np.ndarray:
    """Keys of the passages that are common to a host, given all its distinct main texts."""
    if len(streams) < FEW:
        return np.zeros(0, np.int64)
    keys, held = candidates(streams, host, run, long)
    keys, held = keys[held >= FEW], held[held >= FEW]
    if not len(keys):
        return keys
    page, key, cut = _found(streams, host, keys, run, long)
    own = np.array([(~c).sum() >= OWN * len(c) for c in cut])
    page, key = np.unique(np.stack([page, key])[:, own[page]], axis=1)
    return keys[np.bincount(key, minlength=len(keys)) * 2 > held]


def host_texts(
    pages: list[tuple[list[str] | None, list[str], list[str]]], host: str = "", known: np.ndarray | None = None,
    common: np.ndarray | None = None, run: int = RUN, long: int = LONG, left: float = LEFT,
) -> list[tuple[str, int]]:
    """Main text and number of repeated words outside the article, for one group of
    pages, given as blocks (of the article, evidence only, that may be text); ``known``
    are the keys of runs that other groups of the host hold as well, ``common`` those of
    the passages common to the host. Without the latter the group is the whole host."""
    streams = [_hashes(evidence + other) for _, evidence, other in pages]
    kinds = _kinds(streams)
    repeats = [int(c[s > 0].sum()) for s, c in zip(streams, Runs(streams, run, kinds, f"{run} {host}").covered(known))]
    mains = [other if main is None else main for main, _, other in pages]
    if common is None:
        distinct = {s.tobytes(): s for s in map(_hashes, mains) if len(s)}
        common = common_passages(list(distinct.values()), host, run, long)
    bare = [main is None for main, _, _ in pages]
    if any(bare):
        in_long, in_blocks = (r.covered(known) for r in _cut_runs(streams, host, kinds, run, long))
    cuts = _found([_hashes(main) for main in mains], host, common, run, long)[2] if len(common) else None
    texts = []
    for i, main in enumerate(mains):
        words = [w for t in main for w in t.split(" ")]
        kept = np.ones(len(words), bool) if cuts is None or cuts[i].all() else ~cuts[i]
        if bare[i]:
            cut = in_long[i][streams[i] > 0]
            whole = np.repeat(in_blocks[i][len(in_blocks[i]) - len(main) :], [t.count(" ") + 1 for t in main])
            free = kept & ~(cut[len(cut) - len(whole) :] | whole)
            kept = free if free.sum() >= left * kept.sum() else kept
        texts.append(" ".join(words if kept.all() else (w for w, k in zip(words, kept) if k)))
    return list(zip(texts, repeats))


def _parts(html: str | None) -> tuple[list[str] | None, list[str], list[str]]:
    """Blocks of the article, blocks that are evidence only, and blocks that may be main text."""
    found = blocks(html)
    main = article_blocks(found)
    evidence = [t for p, t in found if p in (CHROME, SHELL) or (main is not None and p == OTHER)]
    return main, evidence, [] if main is not None else [t for p, t in found if p == OTHER]


def _main_stream(host: str, main: list[str] | None, other: list[str]) -> tuple[int, np.ndarray]:
    """Number and stream of a page's main text."""
    stream = _hashes(other if main is None else main)
    return _signed(xxhash.xxh3_64_intdigest(stream.tobytes(), seed=xxhash.xxh3_64_intdigest(host))), stream


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def _short(stream: np.ndarray) -> np.ndarray:
    """A stream in 16 bits a word: enough to find candidates, not to count them."""
    return np.where(stream > 0, np.maximum(stream >> np.uint64(48), np.uint64(1)), np.uint64(0)).astype(np.uint16)


def _host_runs(pages: DataFrame, large: DataFrame) -> DataFrame:
    """Per group ``gid`` of ``pages`` (gid, host, groups, html), whose hosts are those of
    ``large`` (of, groups), the ``keys`` of the runs that it holds in one distinct stream
    only and other groups of the host hold as well, and of the passages ``common`` to the
    host. Main texts are dealt to groups of their own, where equal ones meet."""
    sent = pa.schema([("gid", pa.int64()), ("host", pa.string()), ("stream", pa.binary()), ("main", pa.binary()), ("number", pa.int64())])
    counted = pa.schema([("host", pa.string()), *((c, pa.int64()) for c in ("gid", "key", "low", "high", "gain", "texts"))])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                out: list[dict] = []
                for gid, host_name, groups, html in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns)):
                    main, evidence, other = _parts(html)
                    out.append({"gid": gid, "host": host_name, "stream": _hashes(evidence + other).tobytes()})
                    number, stream = _main_stream(host_name, main, other)
                    if len(stream) and number not in seen:
                        seen.add(number)
                        group = _signed(xxhash.xxh3_64_intdigest(f"{number % groups} {host_name}"))
                        out.append({"gid": group, "host": host_name, "main": _short(stream).tobytes(), "number": number})
                yield pa.RecordBatch.from_pylist(out, sent)

    def rows(**columns: object) -> Iterator[pa.RecordBatch]:
        n = len(columns["key"])
        for lo in range(0, n, 100_000):
            size = min(n - lo, 100_000)
            given = {c: x[lo : lo + size] if isinstance(x, (np.ndarray, list)) else [x] * size for c, x in columns.items()}
            yield pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(size, f.type) for f in counted], schema=counted)

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        mains: dict[int, np.ndarray] = {}
        at = None

        def done() -> Iterator[pa.RecordBatch]:
            for key, low, high in run_rows(held, at[1]) if held else ():
                yield from rows(gid=at[0], key=key, low=low, high=high)
            if mains:
                half = len(mains) // 2
                key, by = candidates(list(mains.values()), at[1])
                yield from rows(host=at[1], key=key, gain=by - half)
                yield from rows(host=at[1], key=[None], gain=half, texts=len(mains))

        for b in batches:
            for gid, host_name, stream, main, number in zip(*(c.to_pylist() for c in b.columns)):
                if at is not None and gid != at[0]:
                    yield from done()
                    held, mains = [], {}
                at = (gid, host_name)
                if stream is not None:
                    held.append(np.frombuffer(stream, np.uint64))
                else:
                    mains[number] = np.frombuffer(main, np.uint16).astype(np.uint64)
        if at is not None:
            yield from done()

    streams = pages.select("gid", "host", "groups", "html").mapInArrow(cut, "gid long, host string, stream binary, main binary, number long")
    found = streams.repartition("gid").sortWithinPartitions("gid").mapInArrow(find, "host string, gid long, key long, low long, high long, gain long, texts long")
    gids = F.collect_list(F.when(F.col("low") == F.col("high"), F.col("gid"))).alias("gids")
    found = found.groupBy("host", "key").agg(F.min("low").alias("low"), F.max("high").alias("high"), gids, F.sum("gain").alias("gain"), F.sum("texts").alias("texts"))
    found = stage(found.where("host is not null or low != high"), "host_runs")
    known = found.where("host is null").select("key", F.explode("gids").alias("gid")).groupBy("gid").agg(F.collect_list("key").alias("keys"))
    # A group that doesn't name a passage has it in half of its texts at most.
    totals = found.where("host is not null and key is null").select("host", F.col("gain").alias("rest"), "texts")
    some = found.where("host is not null and key is not null").select("host", F.col("key").alias("short"), "gain").join(totals, "host")
    some = some.where((F.col("gain") + F.col("rest") >= FEW) & ((F.col("gain") + F.col("rest")) * 2 > F.col("texts"))).select("host", "short", "texts")
    common = _common(pages, stage(some, "candidates"))
    groups = large.select(F.col("of").alias("host"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("dealt"))
    groups = groups.select("host", F.xxhash64("host", "dealt").alias("gid")).join(known, "gid", "left").join(common, "host", "left")
    return groups.select("gid", *(F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in ("keys", "common")))


def _common(pages: DataFrame, some: DataFrame) -> DataFrame:
    """Per host the keys of its ``common`` passages, counted over all its distinct main
    texts; ``some`` (host, short, texts) are the candidates and the number of texts."""
    short_keys = np.sort(np.array([r.short for r in some.select("short").limit(BROADCAST_ROWS + 1).collect()], np.int64))
    if not len(short_keys):
        return some.select("host", F.array().cast("array<bigint>").alias("common"))
    known = short_keys if len(short_keys) <= BROADCAST_ROWS else None

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                held: dict[int, tuple[str, np.ndarray]] = {}
                for host_name, html in zip(*(c.to_pylist() for c in batch.slice(lo, 200).columns)):
                    main, _, other = _parts(html)
                    number, stream = _main_stream(host_name, main, other)
                    if len(stream) and number not in seen:
                        held[number] = host_name, stream
                seen |= held.keys()
                if not held:
                    continue
                names, streams = zip(*held.values())
                short = passages([_short(x).astype(np.uint64) for x in streams], names)[1]
                here = slice(None) if known is None else known[np.minimum(np.searchsorted(known, short), len(known) - 1)] == short
                page, *places = passages(streams, names)
                words = np.array([(x > 0).sum() for x in streams])
                columns = [np.array(list(held), np.int64)[page], words[page], short, *places]
                yield pa.RecordBatch.from_arrays([pa.array(x[here], pa.int64()) for x in columns], names=["number", "words", "short", "key", "first", "last"])

    hosts = small_side(some.select("host").distinct())
    found = pages.join(hosts, "host").select("host", "html").mapInArrow(cut, "number long, words long, short long, key long, first long, last long")
    found = stage(found.join(small_side(some), "short").drop("short"), "passages")
    held = found.select("key", "number").distinct().groupBy("key").agg(F.count("*").alias("held"))
    held = held.join(found.groupBy("key").agg(F.first("host").alias("host"), F.first("texts").alias("texts")), "key")
    held = stage(held.where((F.col("held") >= FEW) & (F.col("held") * 2 > F.col("texts"))).select("host", "key", "held"), "held")
    # Equal texts of several tasks have equal places, which add nothing here.
    text = Window.partitionBy("number")
    before = F.coalesce(F.max("last").over(text.orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = found.select("number", "words", "key", "first", "last").join(small_side(held.select("key")), "key")
    cuts = cuts.withColumn("cut", F.greatest(F.lit(0), F.col("last") - F.greatest("first", before)))
    beside = cuts.withColumn("own", F.col("words") - F.sum("cut").over(text)).where(F.col("own") >= OWN * F.col("words"))
    beside = beside.select("number", "key").distinct().groupBy("key").agg(F.count("*").alias("beside"))
    most = held.join(beside, "key").where("beside * 2 > held")
    return most.groupBy("host").agg(F.collect_list("key").alias("common"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Main text of every page."""
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    sizes = rows.groupBy(host.alias("of")).agg(F.ceil(F.count("*") / PAGES).cast("int").alias("groups"))
    dealt = F.pmod(F.xxhash64("page_id", "url"), F.col("groups").cast("long")).cast("int")
    gid = F.xxhash64("host", dealt)
    kind = rows.schema["page_id"].dataType.simpleString()
    cut_schema = f"page_id {kind}, url string, main binary, evidence array<string>, other array<string>"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                b = batch.slice(lo, 500)
                parts = [_parts(x.as_py()) for x in b.column(2)]
                mains, evidence, others = ([p[i] for p in parts] for i in range(3))
                packed = [None if m is None else zlib.compress("\n".join(m).encode(), 1) for m in mains]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(packed, pa.binary()), pa.array(evidence, pa.list_(pa.string())), pa.array(others, pa.list_(pa.string()))],
                    names=["page_id", "url", "main", "evidence", "other"],
                )

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = known = common = None

        def done() -> pa.RecordBatch:
            pages = [(None if h[2] is None else zlib.decompress(h[2]).decode().split("\n"), *h[3:5]) for h in held]
            texts, repeats = zip(*host_texts(pages, held[0][5], known, common))
            return pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], ids), pa.array([h[1] for h in held], pa.string()), pa.array(texts, pa.string()), pa.array(repeats, pa.int64())],
                names=["page_id", "url", "text", "n_repeated"],
            )

        for b in batches:
            ids = b.column(0).type
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "main", "evidence", "other", "host", "gid")]
            for i, (*page, group) in enumerate(zip(*columns)):
                if group != at:
                    if held:
                        yield done()
                    held, known, common = [], None, None
                at = group
                if b.column("keys")[i].is_valid:
                    known, common = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("keys", "common"))
                else:
                    held.append(tuple(page))
        if held:
            yield done()

    found = rows.mapInArrow(cut, cut_schema).withColumn("host", host)
    sizes = stage(sizes, "hosts")
    found = found.join(small_side(sizes), F.col("host") == F.col("of")).withColumn("gid", gid).drop("of", "groups")
    found = found.withColumns({c: F.lit(None).cast("array<bigint>") for c in ("keys", "common")})
    large = sizes.where("groups > 1")
    if not large.isEmpty():
        of_large = rows.withColumn("host", host).join(small_side(large), F.col("host") == F.col("of")).withColumn("gid", gid)
        found = found.unionByName(_host_runs(of_large, large), allowMissingColumns=True)
    found = found.repartition("gid").sortWithinPartitions("gid")
    texts = found.mapInArrow(join, f"page_id {kind}, url string, text string, n_repeated long")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
