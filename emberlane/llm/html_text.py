"""Main text of web pages: page structure where it is plain, a suffix array over each host's pages where it is not.

What a page marks as article (or main) is its text, less what that part marks as menu, form, advert and the like. Such
marks decide alone, as an article that many pages share is an article all the same. Of pages without an article, what
lies outside marked boilerplate is open: the host's token streams are put one after the other, their suffix array
finds long substrings that distinct pages share, and blocks that these cover go. Unique blocks stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from emberlane.llm.common import slices
from emberlane.session import materialise

# Element names by role.
RAW = set("script style noscript template textarea title iframe svg math canvas object xmp noembed noframes".split())
BOILERPLATE = set("nav footer aside form button select menu dialog head datalist label".split()) | RAW
BLOCKS = set(
    "html body p div h1 h2 h3 h4 h5 h6 hgroup li ul ol dl dt dd table caption thead tbody tfoot tr td th blockquote pre section "
    "article main header footer nav aside figure figcaption hr form fieldset legend address details summary menu center dialog "
    "option select button".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
# Words in a class, an id or a role that mark boilerplate.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices popup modal overlay sidebar menu nav navbar navigation navigations breadcrumb breadcrumbs topbar footer copyright "
    "comment comments reply replies respond disqus discussion social share sharing related recommended recommendations newsletter "
    "subscribe subscription signup login search widget widgets toolbar pagination pager skip complementary contentinfo".split()
)
_NOT_A_MARK = {"has", "with", "no", "without", "show", "hide"}
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][a-zA-Z0-9:_-]*)([^>]*)>"""
    r"""|<[!?][^>]*>|</?[a-zA-Z][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _marked(attributes: str, in_content: bool) -> bool:
    """Whether attributes name a role that is not article text; a heading block inside an article is no page header."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
            continue
        if name not in ("class", "id", "role"):
            continue
        for word in value.split():
            parts = [p for p in re.split(r"[^a-z0-9]+", _CAMEL.sub("-", word).lower()) if p]
            if not parts or parts[0] in _NOT_A_MARK:
                continue
            ends = {parts[0].rstrip("0123456789"), parts[-1].rstrip("0123456789")}
            if ends & MARKS or (not in_content and ends & {"header", "masthead"} and len(parts) < 3):
                return True
    return False


def page_blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """(text blocks of the article, open blocks, marked blocks), each in page order.

    Open blocks there are only where nothing is marked as article or main.
    """
    tags: list[tuple[int, int, bool, str, str]] = []
    at = 0
    while found := _TAG.search(page, at):
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        closing = bool(found[1] or found[4])
        tags.append((found.start(), at, closing, name, found[3] or found[6] or ""))
        if name in RAW and not closing and not (found[3] or "").endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
            if not end:
                tags.append((at, at, True, name, ""))

    until: dict[int, int] = {}  # tag that opens -> place where its element ends
    opened: dict[str, list[int]] = {}
    for i, (_, end, closing, name, _) in enumerate(tags):
        if name and not closing and name not in VOID:
            opened.setdefault(name, []).append(i)
        elif closing and opened.get(name):
            until[opened[name].pop()] = end

    def next_block(i: int) -> int:
        return next((t[0] for t in tags[i + 1 :] if t[3] in BLOCKS), len(page))

    # Marked parts first; the article is what is named so outside them.
    marked: list[tuple[int, int]] = []
    raw: set[tuple[int, int]] = set()  # scripts and the like are nobody's text, not even a menu's
    content: list[tuple[int, int, str]] = []
    inside_content = 0
    for i, (start, end, closing, name, attributes) in enumerate(tags):
        if closing or not name or name in VOID or (marked and start < marked[-1][1]):
            continue
        in_content = start < inside_content
        if name in ("html", "body", "main", "article"):
            if name in ("main", "article"):
                if name == "article" and attributes and _marked(attributes, True):
                    marked.append((start, until.get(i, len(page))))
                    continue
                content.append((start, until.get(i, len(page)), name))
                inside_content = max(inside_content, content[-1][1])
            continue
        if name in BOILERPLATE or (name == "header" and not in_content) or (attributes and _marked(attributes, in_content)):
            marked.append((start, until[i] if i in until else next_block(i)))
            if name in RAW or name == "head":
                raw.add(marked[-1])
    articles = [c[:2] for c in content if c[2] == "article"] or [c[:2] for c in content]

    kinds: list[list[str]] = [[], [], [], []]
    parts: list[str] = []
    kind = 1
    m = a = 0

    def close() -> None:
        text = _SPACE.sub(" ", "".join(parts)).strip()
        if text:
            kinds[kind].append(text)
        parts.clear()

    at, reach = 0, 0
    for start, end, _, name, _ in [*tags, (len(page), len(page), False, "html", "")]:
        if start > at:
            while m < len(marked) and marked[m][1] <= at:
                m += 1
            while a < len(articles) and articles[a][0] <= at:
                reach = max(reach, articles[a][1])
                a += 1
            in_marked = m < len(marked) and marked[m][0] <= at
            now = (3 if marked[m] in raw else 2) if in_marked else 0 if at < reach else 2 if articles else 1
            if now != kind:
                close()
                kind = now
            piece = page[at:start]
            parts.append(html.unescape(piece) if "&" in piece else piece)
        if name in BLOCKS:
            close()
        elif name == "br":
            parts.append(" ")
        at = end
    close()
    return kinds[0], kinds[1], kinds[2]


# Suffix array ---------------------------------------------------------------------------------------------------


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[: max(0, n - step)] = rank[step:]
        order = np.lexsort((later, rank))
        new = np.empty(n, dtype=np.int64)
        differs = (rank[order][1:] != rank[order][:-1]) | (later[order][1:] != later[order][:-1])
        new[order] = np.concatenate([[0], np.cumsum(differs)])
        rank = new
        if rank.max() == n - 1 or step >= n:
            return order
        step *= 2


def window_hashes(stream: list[str], min_tokens: int) -> np.ndarray:
    """A 64-bit hash of every run of ``min_tokens`` tokens, the same in every process."""
    n = len(stream) - min_tokens + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    made = b"".join(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in stream)
    token = np.frombuffer(made, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min_tokens):
        total = total * np.uint64(0x9E3779B97F4A7C15) + token[k : k + n]
    return total.view(np.int64)


def covered(streams: list[list[str]], min_tokens: int, min_pages: int, frequent: np.ndarray | None = None) -> list[np.ndarray]:
    """For each stream, which of its tokens lie in a substring of ``min_tokens`` that ``min_pages`` streams share.

    ``frequent`` are hashes of substrings that so many pages share elsewhere.
    """
    numbers: dict[str, int] = {}
    flat: list[int] = []
    page: list[int] = []
    for p, stream in enumerate(streams):
        flat += [numbers.setdefault(t, len(numbers)) for t in stream]
        flat.append(-1 - p)  # a separator of its own, so that no substring crosses pages
        page += [p] * (len(stream) + 1)
    tokens, pages = np.array(flat, dtype=np.int64), np.array(page, dtype=np.int64)
    inside = np.zeros(len(tokens), dtype=bool)
    if len(tokens):
        order = suffix_array(tokens)
        padded = np.concatenate([tokens, np.full(min_tokens, np.iinfo(np.int64).min)])
        same = np.ones(max(0, len(order) - 1), dtype=bool)
        for k in range(min_tokens):
            same &= padded[order[1:] + k] == padded[order[:-1] + k]
        group = np.concatenate([[0], np.cumsum(~same)])
        distinct = np.unique(group * len(streams) + pages[order])
        shared = np.bincount(distinct // len(streams), minlength=group[-1] + 1) >= min_pages
        for start in (order[shared[group]][:, None] + np.arange(min_tokens)).ravel():
            inside[start] = True
    ends = np.cumsum([len(s) + 1 for s in streams])
    if frequent is not None and len(frequent):
        for s, end in zip(streams, ends, strict=True):
            found = np.flatnonzero(np.isin(window_hashes(s, min_tokens), frequent))
            inside[(end - len(s) - 1 + found[:, None] + np.arange(min_tokens)).ravel()] = True
    return [inside[end - len(s) - 1 : end - 1] for s, end in zip(streams, ends, strict=True)]


def _tokens(opened: list[str], margin: list[str]) -> list[str]:
    return [t for block in [*opened, *margin] for t in block.split()]


def _open_text(
    streams: list[tuple[list[str], list[str]]], min_tokens: int, min_pages: int, share: float, frequent: np.ndarray
) -> list[str]:
    """Text of each page from its open blocks, less those that the host's repeats cover; marked blocks are evidence."""
    tokens = [_tokens(opened, margin) for opened, margin in streams]
    texts = []
    for (opened, _), hit in zip(streams, covered(tokens, min_tokens, min_pages, frequent), strict=True):
        kept, at = [], 0
        for block in opened:
            n = len(block.split())
            if hit[at : at + n].mean() < share:
                kept.append(block)
            at += n
        texts.append("\n".join(kept))
    return texts


# Pages ----------------------------------------------------------------------------------------------------------

_PARSED = "text string, opened array<string>, margin array<string>"


def _parse(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            rows = []
            for page in batch.column("html").to_pylist():
                article, opened, margin = page_blocks(page)
                rows.append((None if opened else "\n".join(article), opened, margin))
            arrays = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *arrays], schema=schema)

    return run


def extract(
    pages: DataFrame,
    *,
    min_tokens: int = 6,
    min_pages: int = 3,
    covered_share: float = 0.8,
    pages_per_group: int = 250,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per row: id, url, text.

    A host's pages are put into groups of about ``pages_per_group`` by a hash, so a host of any size is many tasks' work. An
    open block goes if at least ``covered_share`` of its tokens lie in substrings of ``min_tokens`` that ``min_pages`` pages of
    the host share. Of hosts with several groups every group counts its pages for each substring's hash first; the sums over
    the host go back to the groups that hold the substring.

    Null html counts as empty and gives empty text, as does a page without text. A null or odd url is a host of its own
    kind (empty). Rows with a null or repeated id stay. An empty table gives no rows. Other columns are not read.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, url string, {_PARSED}"
    parsed = materialise(rows.mapInArrow(_parse(to_arrow_schema(StructType.fromDDL(ddl))), ddl), "parsed-pages")
    decided = parsed.filter(F.col("text").isNotNull()).select("id", "url", "text")

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    streams = parsed.select("id", "url", host.alias("host"), F.col("text").isNull().alias("is_open"), "opened", "margin")
    # Hosts where every page is decided have nothing to find.
    needed = streams.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.max("is_open").alias("any_open"))
    needed = materialise(needed.filter("any_open").select("host", "n"), "open-hosts")
    groups = F.ceil(F.col("n") / pages_per_group)
    dealt = streams.join(needed, "host").withColumn("part", F.pmod(F.xxhash64("id", "url"), groups))

    def count(group: pd.DataFrame) -> pd.DataFrame:
        pages = [np.unique(window_hashes(_tokens(o, m), min_tokens)) for o, m in zip(group["opened"], group["margin"], strict=True)]
        window, n = np.unique(np.concatenate(pages), return_counts=True)
        return pd.DataFrame({"host": group["host"].iloc[0], "part": group["part"].iloc[0], "window": window, "n": n.astype(np.int64)})

    several = dealt.filter(F.col("n") > pages_per_group).groupBy("host", "part")
    counted = several.applyInPandas(count, "host string, part bigint, window bigint, n bigint").groupBy("host", "window")
    counted = counted.agg(F.sum("n").alias("n"), F.collect_list("part").alias("parts")).filter(F.col("n") >= min_pages)
    frequent = counted.select("host", F.explode("parts").alias("part"), "window")

    def decide(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "url"], kind="stable", na_position="last")
        streams = list(zip(group["opened"], group["margin"], strict=True))
        found = _open_text(streams, min_tokens, min_pages, covered_share, shared["window"].to_numpy())
        return group.assign(text=found).loc[group["is_open"], ["id", "url", "text"]]

    repeats = dealt.groupBy("host", "part").cogroup(frequent.groupBy("host", "part"))
    repeats = repeats.applyInPandas(decide, f"id {kind}, url string, text string")
    return decided.unionByName(repeats).withColumnsRenamed({"id": id_col, "url": url_col})
