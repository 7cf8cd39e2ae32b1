"""Main text of web pages by a suffix array for each host.

A tolerant tokenizer turns a page into blocks, with what markup says of each: inside an article, inside
the main element, elsewhere, or inside an element that markup marks as navigation, header, footer, aside,
form, advert, notice or reader comments.

The token streams of all pages of a host, without the blocks in an article (or else main) element, are
concatenated, and a suffix array sorted to the depth of the shortest counted repeat finds the token runs
that recur on several distinct pages of the host. Tokens in such runs are boilerplate and go, and unique
runs stay. A run may go on over the borders of blocks, as menus do: then only the blocks go that it covers
whole. Markup is a prior: what it marks never stays, and blocks in an article (or else main) element stay
although other pages repeat them, as copies of articles are articles. If such an element has at least as
many tokens as survive elsewhere, it is the text; otherwise it is a teaser, and the text is all that
survives. An element that outweighs all other blocks before any run goes is the text whatever survives:
such a page's text does not move, its stream only counts for the host's other pages.

Pages of equal blocks count as one page for the repeats. A host of more than ``block_chars`` characters is
dealt by a hash of the blocks into parts with a suffix array each. A part counts its runs' pages, the
counts are summed over the host's parts, and each part gets back which of its runs recur, so the result
does not depend on the parts.

Edge cases: a null or empty html gives the empty text; a page with an unclosed element is read to its
end; repeated rows are each extracted; a page without an article, alone on its host, keeps all its open
blocks; pages without a host are a host; a sign < that no > follows is text; after ``BAD_TAGS`` tags whose
quotes do not close, tags of that page end at the next >. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow
from .url_rules import parsed

NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# Element names and the words of class, id and role that mark what is not the article.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head nav footer aside form noscript template svg math select button dialog menu object canvas audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption option".split())
SPACED = frozenset("br td th img".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar side aside rail widget footer foot header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social related recommended recommendations trending popular comment comments commentlist disqus discussion replies respond reply pagination pager skip search copyright legal disclaimer paywall tags tagcloud".split())
COMMENT_WORDS = frozenset("comment comments commentlist disqus discussion replies respond reply teaser related recommended promo ad ads advert sponsored".split())
GOOD_WORDS = frozenset("article articlebody content main body text post entry story page wrapper container".split())


@dataclass(frozen=True)
class ExtractConfig:
    run_tokens: int = 6
    min_pages: int = 3
    block_chars: int = 4_000_000


BAD_TAGS = 8
ARTICLE, MAIN, ELSEWHERE, MARKED = 2, 1, 0, -1


def _words(value: str) -> list[list[str]]:
    return [[w.lower() for w in PARTS.findall(name)] for name in value.split()]


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether the element's markup says that it isn't the article's text."""
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "").lower()):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    names = _words(a.get("class", "") + " " + a.get("id", ""))
    if tag in ("article", "main"):
        return any(n and n[0] in COMMENT_WORDS for n in names)
    if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "span", "b", "i", "em", "strong") and in_article:
        return any(len(n) == 1 and n[0] in BAD_WORDS - {"side", "legal", "alert", "popular", "text", "header"} for n in names)
    return any(n and (n[0] in BAD_WORDS or n[-1] in BAD_WORDS) and not (GOOD_WORDS & set(n)) for n in names)


def _container(tag: str, attributes: str) -> int:
    """2: article; 1: main; 0: neither."""
    if tag == "article" or "articleBody" in attributes:
        return 2
    return int(tag == "main" or 'role="main"' in attributes)


def _tags(page: str):
    """(start, end, name, closing, attributes, text) of every piece of markup; name is None for comments, declarations and CDATA, whose text is given. Reading goes on at what is sent."""
    at, size, bad = 0, len(page), 0
    while True:
        start = page.find("<", at)
        if start < 0:
            return
        end, made = -1, None
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            end, made = (end if end > 2 else size), (None, False, "", None)
        elif page.startswith("<![CDATA[", start) and (close := page.find("]]>", start + 9)) >= 0:
            end, made = close + 3, (None, False, "", page[start + 9 : close])
        elif page.startswith(("<!", "<?"), start):
            end, made = page.find(">", start + 2) + 1, (None, False, "", None)
        elif m := NAME.match(page, start):
            rest = REST.match(page, m.end()) if bad < BAD_TAGS else None
            if rest:
                end, attributes = rest.end(), rest[1]
            else:
                bad += 1
                end = page.find(">", m.end()) + 1
                attributes = page[m.end() : end - 1] if end else ""
            made = (m[1].lower(), page[start + 1] == "/", attributes, None)
        else:
            at = start + 1
            continue
        if end <= 0:
            # no > follows, so no tag does; a comment may
            at = page.find("<!--", start + 1)
            if at < 0:
                return
            continue
        at = (yield (start, end, *made)) or end


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(level, text) of the page's blocks in order; see the levels above. Scripts, styles and the like are left out."""
    if not page:
        return []
    out: list[tuple[int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open containers: tag, level, depth
    dropping: list[str] = []  # nested elements of the name that is being dropped
    depth: dict[str, int] = {}
    last_close: dict[str, int] = {}
    level = at = 0
    size = len(page)
    lowered = None

    def flush() -> None:
        if buffer:
            text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                out.append((MARKED if dropping else level, text))

    def closes_later(name: str, after: int) -> bool:
        if name not in last_close:
            last_close[name] = max((m.start() for m in re.finditer(f"</{name}\\b", page, re.I)), default=-1)
        return last_close[name] >= after

    tags, skip = _tags(page), None
    while True:
        try:
            start, end, tag, closing, attributes, literal = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            buffer.append(page[at:start])
        at = end
        if tag is None:
            if literal is not None and not dropping:
                buffer.append(literal.replace("&", "&amp;").replace("<", "&lt;"))
            continue
        if not closing and tag in RAW:
            if lowered is None:
                lowered = page.lower()
            end = lowered.find("</" + tag, at) if len(lowered) == size else page.find("</" + tag, at)
            at = skip = size if end < 0 else page.find(">", end) + 1 or size
            continue
        if dropping:
            if tag in BLOCKS:
                flush()
            if tag == dropping[-1]:
                if closing:
                    flush()
                    dropping.pop()
                elif tag not in VOID:
                    dropping.append(tag)
            elif not closing and _container(tag, attributes) and not _dropped(tag, attributes, False) and not closes_later(dropping[0], at):
                flush()
                dropping.clear()  # an element that is never closed does not hide the article
            elif closing and (tag == "body" or dropping[0] == "head" and tag == "html"):
                flush()
                dropping.clear()
            elif dropping[0] == "head" and tag == "body":
                flush()
                dropping.clear()
            if dropping or closing:
                if dropping and tag in SPACED:
                    buffer.append(" ")
                continue
        if tag in BLOCKS:
            flush()
        elif tag in SPACED:
            buffer.append(" ")
        if closing:
            depth[tag] = max(0, depth.get(tag, 0) - 1)
            if stack and stack[-1][0] == tag and depth[tag] < stack[-1][2]:
                stack.pop()
                level = stack[-1][1] if stack else 0
            continue
        if tag in VOID:
            continue
        if _dropped(tag, attributes, level > 0):
            flush()
            dropping.append(tag)
            continue
        depth[tag] = depth.get(tag, 0) + 1
        kind = _container(tag, attributes)
        if kind:
            flush()
            level = max(level, kind)
            stack.append((tag, level, depth[tag]))
    if at < size:
        buffer.append(page[at:])
    flush()
    return out


def _best(found: list[tuple[int, str]]) -> int:
    """The level of the page's article, or else main element; ELSEWHERE if it has none."""
    return max((k for k, _ in found), default=ELSEWHERE)


def _sizes(found: list[tuple[int, str]]) -> list[int]:
    """Tokens of each block in the host's stream: none of an article."""
    best = max(ELSEWHERE, _best(found))
    return [0 if level == best > ELSEWHERE else text.count(" ") + 1 for level, text in found]


def prepared(found: list[tuple[int, str]]) -> tuple[str | None, list[tuple[int, str]]]:
    """(text, blocks): the text if an article outweighs all other blocks, else None, and the blocks that the host's array needs."""
    best = max(ELSEWHERE, _best(found))
    own = [t for k, t in found if k == best > ELSEWHERE]
    outside = sum(n for (k, _), n in zip(found, _sizes(found)) if k != MARKED)
    if sum(t.count(" ") + 1 for t in own) >= outside:
        return "\n\n".join(own), [(k, t) for k, t in found if k != best or best == ELSEWHERE]
    return None, found


def main_text(found: list[tuple[int, str]], removed: list[np.ndarray]) -> str:
    """The text of a page from its blocks and, for those that are in the stream, the masks of what recurs on the host."""
    best = max(ELSEWHERE, _best(found))
    kept = []
    inside = outside = 0
    for (level, text), mask in zip(found, removed):
        if level == best > ELSEWHERE:
            kept.append((True, text))
            inside += text.count(" ") + 1
        elif level != MARKED and not mask.all():
            kept.append((False, " ".join(t for t, c in zip(text.split(" "), mask) if not c)))
            outside += int((~mask).sum())
    settled = inside and inside >= outside
    return "\n\n".join(t for own, t in kept if own or not settled)


def _run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A 64-bit hash of the run of tokens at each place, the same in every part of a host."""
    x = np.zeros(max(0, len(tokens) - run + 1), dtype=np.uint64)
    for k in range(run):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(x)]
    return x ^ (x >> np.uint64(32))


def run_classes(pages: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the pages' tokens, with a separator of its own after every page, by prefix doubling to the depth of ``run``.

    Returns, for each token and separator of all pages in order, the class of the run that starts there;
    the number of distinct pages of each class; and whether a whole run starts there.
    """
    ids: dict[str, int] = {}
    lengths = np.array([len(p) for p in pages], dtype=np.int64)
    n = int(lengths.sum()) + len(pages)
    stream = np.fromiter((x for k, page in enumerate(pages) for x in (*(ids.setdefault(t, len(ids)) for t in page), -1 - k)), dtype=np.int64, count=n)
    owner = np.repeat(np.arange(len(pages)), lengths + 1)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    depth = 1
    while depth < run and n:
        step = min(depth, run - depth)
        shifted = np.full(n, -1, dtype=np.int64)
        shifted[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + shifted + 1, return_inverse=True)[1].astype(np.int64)
        depth += step
    order = np.lexsort((owner, rank))  # suffixes with the same first tokens by page
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (rank[order][1:] != rank[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(rank[order][fresh], minlength=n)
    left = np.cumsum(lengths + 1)[owner] - 1 - np.arange(n)  # tokens of the page from here on
    return rank, distinct, left >= run


def covered_masks(pages: list[list[str]], starts: np.ndarray, run: int) -> list[np.ndarray]:
    """For each page a mask of the tokens in runs that start where ``starts`` is true."""
    n = len(starts)
    mark = np.zeros(n + run, dtype=np.int64)
    at = np.flatnonzero(starts)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + run, -1)
    covered = np.cumsum(mark[:n]) > 0
    ends = np.cumsum([len(p) + 1 for p in pages])
    return [covered[e - len(p) - 1 : e - 1] for e, p in zip(ends, pages)]


def repeated(pages: list[list[str]], run: int, least: int) -> np.ndarray:
    """Where the runs of ``run`` tokens start that recur on ``least`` distinct pages."""
    rank, distinct, whole = run_classes(pages, run)
    return whole & (distinct[rank] >= least)


def _contents(group: pd.DataFrame) -> tuple[pd.DataFrame, list[list[tuple[int, str]]], list[list[str]]]:
    """The distinct contents of a part, their blocks and their token streams."""
    content = group.drop_duplicates("content").sort_values("content", kind="stable")
    found = [[(k, t) for k, t in json.loads(b)] for b in content["blocks"]]
    return content, found, [[t for (_, text), n in zip(page, _sizes(page)) if n for t in text.split(" ")] for page in found]


def removed_tokens(found: list[list[tuple[int, str]]], streams: list[list[str]], starts: np.ndarray, run: int) -> list[list[np.ndarray]]:
    """For each page and block a mask of what recurs: tokens in runs within the block, and blocks that runs cover whole, also over borders."""
    sizes = [_sizes(page) for page in found]
    left = np.array([x for page in sizes for x in (*(k for n in page for k in range(n, 0, -1)), 0)], dtype=np.int64)
    within, any_run = covered_masks(streams, starts & (left >= run), run), covered_masks(streams, starts, run)
    out = []
    for page, own, other in zip(sizes, within, any_run):
        ends = np.cumsum(page)[:-1]
        out.append([np.ones_like(a) if b.all() else a for a, b in zip(np.split(own, ends), np.split(other, ends))] if page else [])
    return out


def _texts(group: pd.DataFrame, run: int, starts_of) -> pd.DataFrame:
    """page_id, url, text of the open pages of a part; ``starts_of`` tells where the runs that recur start in its distinct contents."""
    open_ones = group[group["open"]]
    if not len(open_ones):
        return pd.DataFrame({"page_id": [], "url": [], "text": []}, dtype=object)
    content, found, streams = _contents(group)
    masks = removed_tokens(found, streams, starts_of(streams), run)
    texts = {c: main_text(page, own) for c, is_open, page, own in zip(content["content"], content["open"], found, masks) if is_open}
    return pd.DataFrame({"page_id": open_ones["page_id"].to_numpy(), "url": open_ones["url"].to_numpy(), "text": open_ones["content"].map(texts).to_numpy()})


RESULT = "page_id string, url string, text string"


def _by_summed_counts(pages: DataFrame, cfg: ExtractConfig) -> DataFrame:
    """Texts of the open pages of hosts of several parts."""
    run, least = cfg.run_tokens, cfg.min_pages

    def hashes(streams: list[list[str]]) -> np.ndarray:
        """The hash of the run that starts at each token and separator; of no meaning where no whole run does."""
        codes = [np.append(pd.util.hash_array(np.array(s, dtype=object), categorize=False), np.uint64(0)) if s else np.zeros(1, np.uint64) for s in streams]
        flat = np.concatenate([*codes, np.zeros(run - 1, np.uint64)])
        return _run_hashes(flat, run)

    def count(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, _, streams = _contents(group)
        rank, distinct, whole = run_classes(streams, run)
        at = np.flatnonzero(whole)
        _, one = np.unique(rank[at], return_index=True)
        at = at[one]
        h, n = hashes(streams)[at], distinct[rank[at]].astype(np.uint32)
        bucket = (h % np.uint64(group["parts"].iloc[0])).astype(np.int64)
        rows = [(b, h[bucket == b].tobytes(), n[bucket == b].tobytes()) for b in np.unique(bucket)]
        return pd.DataFrame({"host": key[0], "part": key[1], "bucket": [r[0] for r in rows], "runs": [r[1] for r in rows], "pages": [r[2] for r in rows]})

    counted = pages.groupBy("host", "part").applyInPandas(count, "host string, part long, bucket long, runs binary, pages binary")

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        runs = [np.frombuffer(r, np.uint64) for r in group["runs"]]
        name, place = np.unique(np.concatenate(runs), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.frombuffer(p, np.uint32) for p in group["pages"]]))
        often = (n >= least)[place]
        kept = [r[o] for r, o in zip(runs, np.split(often, np.cumsum([len(r) for r in runs])[:-1]))]
        return pd.DataFrame({"host": key[0], "part": group["part"].to_numpy(), "often": [k.tobytes() for k in kept]})

    often = counted.groupBy("host", "bucket").applyInPandas(total, "host string, part long, often binary")

    def judge(group: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        names = np.concatenate([np.frombuffer(o, np.uint64) for o in known["often"]] or [np.empty(0, np.uint64)])

        def starts(streams: list[list[str]]) -> np.ndarray:
            left = np.concatenate([np.arange(len(s), -1, -1) for s in streams])
            return (left >= run) & np.isin(hashes(streams), names)

        return _texts(group, run, starts)

    return pages.groupBy("host", "part").cogroup(often.groupBy("host", "part")).applyInPandas(judge, RESULT)


def extract_pages(pages: DataFrame, cfg: ExtractConfig = ExtractConfig()) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    run, least = cfg.run_tokens, cfg.min_pages

    def parsing():
        def work(some: list[dict]) -> list[dict]:
            out = []
            for r in some:
                found = blocks(r["html"])
                text, needed = prepared(found)
                name = hashlib.blake2b(json.dumps(found).encode(), digest_size=8).digest()
                out.append({"page_id": r["page_id"], "url": r["url"], "host": r["host"], "text": text, "open": text is None, "blocks": json.dumps(needed, ensure_ascii=False), "content": int.from_bytes(name, "little", signed=True)})
            return out

        return work

    rows = pages.select("page_id", "url", parsed(F.col("url"))[0].alias("host"), "html")
    found = durable(map_arrow(rows, parsing, "page_id long, url string, host string, text string, open boolean, blocks string, content long", rows=64))
    done = found.where("not open").select("page_id", "url", "text")
    # hosts without an open page need no array
    loads = durable(found.groupBy("host").agg(F.ceil(F.sum(F.length("blocks")) / cfg.block_chars).alias("parts"), F.max("open").alias("open")).where("open").drop("open"))
    if loads.isEmpty():
        judged = done.limit(0)
    else:
        streams = found.where("blocks != '[]' or open").join(loads, found["host"].eqNullSafe(loads["host"])).select(F.col("page_id").cast("string").alias("page_id"), "url", found["host"], "parts", F.pmod("content", "parts").alias("part"), "open", "blocks", "content")
        whole = streams.where("parts = 1").groupBy("host").applyInPandas(lambda group: _texts(group, run, lambda tokens: repeated(tokens, run, least)), RESULT)
        judged = whole.unionByName(_by_summed_counts(streams.where("parts > 1"), cfg)).withColumn("page_id", F.col("page_id").cast("long"))
    return done.unionByName(judged).withColumn("n_chars", F.length("text").cast("long"))
