"""Main text of pages by nearest-URL page differencing.

1. Every page is cut into text lines (blocks) in page order.  A line carries its role: in a landmark of the main text, in
   a landmark or element that is no main text, in an element whose names say so, or undecided.
2. Pages of a host are paired with the nearest page by URL: the neighbour in the order of paths with the longer common
   beginning.  Lines are aligned by longest common subsequence, and shared lines are deleted.
3. An exact check follows, since two articles may share a passage and two menus may differ: lines of a main landmark
   stay though they are shared, lines of other landmarks go though they are not.  All other lines are the differencing's:
   shared ones go; of those that are not shared, names of class, id or role take away what they mark.

Pages are ordered over all hosts by range partitions, so a host with a third of all pages is cut into many tasks.  Pages
travel once, compressed, and are read once, where their neighbours are.  The first and last run of a task wait for a table
of two rows a task, which tells them of the neighbours beyond the task's ends.

Defined results for odd input
* null html counts as empty and gives an empty text; a null url has no host: such pages pair with one another by id;
* a page alone on its host shares nothing; repeated rows share nothing by being copies: pages with the same lines that
  follow one another are one run, which is paired with the nearest run before or after it;
* very long pages are read whole; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable

# Fixed values of HTML: elements by what they mean for text.
UNSEEN = frozenset("script style noscript template svg math iframe object head title textarea select option button canvas audio video map datalist".split())
RAW = frozenset("script style textarea title".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
MAIN = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: Words of class, id or role that mark what is no main text: a whole one does, one between hyphens is doubtful.
ASIDE_WORDS = (
    r"(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookie\w*|consent|notice|notification|newsletter|subscribe|popup|modal|"
    r"nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|widget|related|share|social|comments?|disqus|respond|"
    r"complementary|contentinfo|search|toolbar|pagination|skip)"
)
ASIDE_NAMES = re.compile(ASIDE_WORDS, re.I)
DOUBTFUL_NAMES = re.compile(rf"(?:^|[_-]){ASIDE_WORDS}(?:$|[_-])", re.I)
MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:main|article|post-content|entry-content|article-body|main-content)(?:$|[\s_-])", re.I)
#: Comments, declarations and tags.  A quote opens a value only after an equals sign; elsewhere it is part of a name.
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))?)*+)(?:>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
TELLING = re.compile(r"class|id|role|hidden", re.I)

MAIN_ROLE = re.compile(r"(?:^|\s)role\s*=\s*[\"']?\s*main(?=$|[\s\"'])", re.I)
#: Elements that no class, id or role drops.
WHOLE = frozenset("html body".split()) | MAIN

UNDECIDED, KEEP, DROP = 0, 1, 2
#: Marked by names alone; and, while parsing, in a main landmark but of a doubtful name, whose lines are undecided.
NAMED, DOUBTFUL = 3, 4


def role(name: str, attributes: str, above: int, spared: bool = False) -> int:
    """What an element makes of its text.  Nothing within what is dropped is kept; the names of what is spared do not drop it."""
    if above == DROP or name in UNSEEN or name in ASIDE and not (above in (KEEP, DOUBTFUL) and name == "header"):
        return DROP
    named = doubtful = main = False
    if attributes:
        for key, a, b, c in ATTRIBUTE.findall(attributes) if TELLING.search(attributes) else ():
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return DROP
            if key in ("class", "id", "role"):
                for word in value.split():
                    if ASIDE_NAMES.fullmatch(word):
                        # an article's own header is no page header
                        named, doubtful = (named, True) if above in (KEEP, DOUBTFUL) and word.lower() in ("header", "banner") else (True, doubtful)
                    elif DOUBTFUL_NAMES.search(word):
                        doubtful = True
                    elif MAIN_NAMES.search(word):
                        main = True
    whole = name in WHOLE or MAIN_ROLE.search(attributes or "") is not None
    if above == NAMED or named and not whole and not spared:
        return NAMED
    if name in MAIN or main and above != KEEP:
        return KEEP
    return DOUBTFUL if above == KEEP and (doubtful or named) and not whole else above


def landmark(name: str, attributes: str) -> int:
    """2 for the main landmark of a page, 1 for an element that may be one of many, else 0."""
    if name == "main" or MAIN_ROLE.search(attributes):
        return 2
    return int(name == "article")


def lines_of(page: str, spared: frozenset[int] = frozenset()) -> list[tuple[int, str]]:
    """(role, text) of the blocks in page order: references decoded, white space one space, empty blocks left out.

    An element around a main landmark is not dropped for its names: the page is then read again with the places of such
    elements as `spared`.  Around articles this holds where the page has no other main text, since comments and teasers
    may be articles too.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int | None]] = []  # name, role above, place if dropped for its names
    around: dict[int, set[int]] = {1: set(), 2: set()}
    now, at, text = UNDECIDED, 0, []

    def close() -> None:
        line = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        if line:
            out.append((UNDECIDED if now == DOUBTFUL else now, line))

    while True:
        tag = TAG.search(page, at)
        text.append(page[at : tag.start()] if tag else page[at:])
        if not tag:
            break
        at = max(tag.end(), at + 1)
        name = (tag[2] or "").lower()
        if not name:
            continue
        if not tag[1]:
            new = role(name, tag[3], now, tag.start() in spared)
            if now == NAMED == new and (rank := landmark(name, tag[3])):
                around[rank].update(x[2] for x in stack if x[2] is not None)
            if name in BLOCKS or new != now:
                close()
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if name == "p":  # a paragraph ends an open one
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a") and any(x[0] == "p" for x in stack):
                    now = stack.pop()[1]
            if name not in VOID and not tag[3].rstrip().endswith("/"):
                stack.append((name, now, tag.start() if new == NAMED else None))
                now = new
        else:
            if name in BLOCKS:
                close()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if stack[k][1] != now:
                        close()
                    now = stack[k][1]
                    del stack[k:]
                    break
                if stack[k][0] in MAIN | ASIDE and name not in MAIN | ASIDE | {"body", "html"}:
                    break  # a stray end tag does not close a landmark
    close()
    more = around[2] or (set() if any(r == KEEP for r, _ in out) else around[1])
    return lines_of(page, spared | more) if more - spared else out


def shared_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which elements of `a` lie on a longest common subsequence with `b`.

    Equal beginnings and ends are matched first and lines that only one page has are left out; both leave the length of
    the longest subsequence as it is.  The table of the rest is filled row by row.
    """
    out = np.zeros(len(a), bool)
    n, m, low = len(a), len(b), 0
    while low < min(n, m) and a[low] == b[low]:
        out[low] = True
        low += 1
    while n > low and m > low and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
        out[n] = True
    ia = low + np.flatnonzero(np.isin(a[low:n], b[low:m]))
    x = a[ia]
    y = b[low:m][np.isin(b[low:m], x)]
    if not len(x) or not len(y):
        return out
    out[ia[np.array(aligned(x, y), int)]] = True
    return out


def ends(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of x with every beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == v)))
    return row


def aligned(x: np.ndarray, y: np.ndarray, cells: int = 1_000_000) -> list[int]:
    """Indices of x on a longest common subsequence.  A table beyond so many cells is halved, in linear memory."""
    if not len(x) or not len(y):
        return []
    if len(x) > 1 and len(x) * len(y) > cells:
        half = len(x) // 2
        cut = int((ends(x[:half], y) + ends(x[half:][::-1], y[::-1])[::-1]).argmax())
        return aligned(x[:half], y[:cut], cells) + [half + i for i in aligned(x[half:], y[cut:], cells)]
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        table[i, :-1] = np.maximum.accumulate(np.maximum(table[i + 1, :-1], table[i + 1, 1:] + (y == x[i]))[::-1])[::-1]
    i = j = 0
    on = []
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            on.append(i)
            i, j = i + 1, j + 1
        elif table[i + 1, j] >= table[i, j + 1]:
            i += 1
        else:
            j += 1
    return on


def main_text(roles: list[int], texts: list[str], shared: np.ndarray) -> tuple[str, int]:
    """What stays after differencing and the exact check, and how many lines the differencing deleted.

    `shared` may be empty where nothing is.
    """
    gone = shared if len(shared) else np.zeros(len(texts), bool)
    kept = "\n".join(t for r, t, s in zip(roles, texts, gone, strict=True) if r == KEEP or r == UNDECIDED and not s)
    return kept, sum(bool(s) for r, s in zip(roles, gone, strict=True) if r in (UNDECIDED, NAMED))


def line_hashes(texts: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.array([xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], "<u8")


def common_beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Run:
    """Pages of a host that follow one another in the order of URLs and have the same lines."""

    def __init__(self, host: str, path: str, texts: list[str], lines: bytes):
        self.host, self.first, self.last, self.texts, self.lines = host, path, path, texts, lines
        self.pages: list[tuple[int | None, str | None, list[int]]] = []

    def verdict(self, before: Run | None, after: Run | None) -> tuple[int, bytes]:
        """(length of the common beginning of the paths, packed bits of the lines shared with the nearer neighbour)."""
        near = [(common_beginning(self.first, r.last) if r is before else common_beginning(self.last, r.first), r) for r in (before, after) if r and r.host == self.host]
        if not near:
            return -1, b""
        common, other = max(near, key=lambda x: x[0])
        mine, theirs = (np.frombuffer(r.lines, "<u8") for r in (self, other))
        return common, np.packbits(shared_lines(mine, theirs)).tobytes()


def unpacked(shared: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(shared, np.uint8), count=n).astype(bool) if shared else np.zeros(0, bool)


#: Rows that are done have no `task`; rows of a task's first (place 0) or last run wait with their lines in `body`; the
#: ends themselves have a `path` and the hashes of their `lines`.
DECIDED = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared", pa.int64()), ("body", pa.binary())]
    + [("task", pa.int32()), ("place", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("lines", pa.binary()), ("common", pa.int32()), ("shared", pa.binary())]
)
DECIDED_DDL = "page_id long, url string, text string, n_chars long, n_shared long, body binary, task int, place int, host string, path string, lines binary, common int, shared binary"
#: Rows and characters of a batch of results.
BATCH_ROWS, BATCH_CHARS = 4000, 16_000_000


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in the order of host, path and key: each read once and differenced with its neighbours."""
    import zstandard
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    press, depress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

    def runs() -> Iterator[Run]:
        now = None
        for batch in batches:
            for page_id, url, host, path, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = lines_of(depress.decompress(body).decode("utf-8", "surrogatepass"))
                roles, texts = [r for r, _ in lines], [t for _, t in lines]
                hashes = line_hashes(texts).tobytes()
                if now is None or now.host != host or now.lines != hashes:
                    if now:
                        yield now
                    now = Run(host, path, texts, hashes)
                now.last = path
                now.pages.append((page_id, url, roles))
        if now:
            yield now

    def rows(run: Run, before: Run | None, after: Run | None) -> Iterator[tuple]:
        common, shared = run.verdict(before, after)
        if before is not None and after is not None:
            gone = unpacked(shared, len(run.texts))
            for page_id, url, roles in run.pages:
                text, n = main_text(roles, run.texts, gone)
                yield (page_id, url, text, len(text), n, *[None] * 8)
            return
        place = 0 if before is None else 1
        for page_id, url, roles in run.pages:
            # a line never holds a line feed, so it can part the lines; roles are one digit each, in front
            body = press.compress("\n".join(["".join(map(str, roles)), *run.texts]).encode("utf-8", "surrogatepass"))
            yield (page_id, url, None, None, None, body, task, place, *[None] * 5)
        for end, path in [(0, run.first)] * (before is None) + [(1, run.last)] * (after is None):
            yield (*[None] * 6, task, end, run.host, path, run.lines, common, shared)

    def results() -> Iterator[tuple]:
        before = now = None
        for after in runs():
            if now:
                yield from rows(now, before, after)
                before = now
                before.pages = []
            now = after
        if now:
            yield from rows(now, before, None)

    out, size = [], 0
    for row in results():
        out.append(row)
        size += len(row[2] or "") + len(row[5] or "") + len(row[10] or "")
        if len(out) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), DECIDED.types, strict=True)], schema=DECIDED)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), DECIDED.types, strict=True)], schema=DECIDED)


def beyond(frame: pd.DataFrame) -> pd.DataFrame:
    """The verdict for the first and last run of every task, from the ends of all tasks.

    Ends that follow one another with the same lines are one run; it takes the best of what its members found in their
    tasks and of what the ends before and after it tell.
    """
    frame = frame.sort_values(["task", "place"], ignore_index=True)
    groups: list[list[int]] = []
    for i in range(len(frame)):
        alike = bool(groups) and frame["host"][i] == frame["host"][i - 1] and frame["lines"][i] == frame["lines"][i - 1]
        # the first and last run of one task are one only if neither had a neighbour there
        if alike and (frame["task"][i] != frame["task"][i - 1] or frame["common"][i] < 0):
            groups[-1].append(i)
        else:
            groups.append([i])
    out = []
    for g, members in enumerate(groups):
        run = Run(frame["host"][members[0]], frame["path"][members[0]], [], frame["lines"][members[0]])
        run.last = frame["path"][members[-1]]
        around: list[Run | None] = []
        for h, at in ((g - 1, -1), (g + 1, 0)):
            other = groups[h][at] if 0 <= h < len(groups) else None
            mine = members[0] if at else members[-1]
            ok = other is not None and frame["task"][other] != frame["task"][mine]
            around.append(Run(frame["host"][other], frame["path"][other], [], frame["lines"][other]) if ok else None)
        best = max([(int(frame["common"][i]), 0, frame["shared"][i] or b"") for i in members] + [(c, 1, s) for c, s in [run.verdict(*around)]], key=lambda x: x[:2])
        out += [(frame["task"][i], frame["place"][i], best[2]) for i in members]
    return pd.DataFrame(out, columns=["task", "place", "shared"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text, n_chars``, and ``n_shared``, the lines that differencing deleted."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, HOST, 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*", ""), r"/?(?:[?#].*)?$", "")
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))

    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            blobs = pa.array([press.compress(h) for h in batch.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], blobs], names=["page_id", "url", "host", "path", "body"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[list] = [[], [], []]
            for body, shared in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                roles, *texts = press.decompress(body).decode("utf-8", "surrogatepass").split("\n")
                text, n = main_text([int(r) for r in roles], texts, unpacked(shared, len(roles)))
                for column, value in zip(out, (text, len(text), n), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_shared"])

    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # compressed pages order rows that are alike in all else, so that the order is total
    order = [F.col("host"), F.col("path"), F.col("page_id"), F.col("url"), F.crc32("body")]
    travelling = source.mapInArrow(sealed, "page_id long, url string, host string, path string, body binary")
    ordered = travelling.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = durable(ordered.mapInArrow(decided, DECIDED_DDL), codec="zstd")
    ends = rows.filter("path is not null").select("task", "place", "host", "path", "lines", "common", "shared").groupBy().applyInPandas(beyond, "task int, place int, shared binary")
    waiting = rows.filter("body is not null").select("page_id", "url", "body", "task", "place")
    # two rows a task, of a bit for each line of a page
    told = waiting.join(F.broadcast(ends), ["task", "place"]).select("page_id", "url", "body", "shared")
    done = rows.filter("text is not null").select("page_id", "url", "text", "n_chars", "n_shared")
    return done.union(told.mapInArrow(finished, "page_id long, url string, text string, n_chars long, n_shared long"))
