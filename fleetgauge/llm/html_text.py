"""Main text of HTML pages: blocks by structure, boilerplate by runs of tokens repeated over each host's pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .url_rules import url_host

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z!?][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = frozenset("script style textarea title noscript template svg iframe object math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td
tfoot th thead tr ul""".split())
_CHROME = frozenset("nav aside footer form menu dialog button select head".split())
_MAIN = frozenset(["article", "main"])
#: Parts of class, id and role names that mark page furniture.
_MARKS = frozenset("""ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent
contentinfo cookie cookies disclaimer footer gdpr login menu modal nav navbar navigation newsletter notice notification pagination
popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored
subscribe toolbar topbar widget""".split())


@dataclass(frozen=True)
class Block:
    """One block of visible text: inside an article or main element? inside page furniture?"""

    text: str
    main: bool
    chrome: bool


def page_blocks(source: str) -> list[Block]:
    """The blocks of visible text in page order. Unclosed and stray tags are forgiven as browsers do."""
    blocks: list[Block] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []      # name, and whether it or an element around it is main, is furniture
    main = chrome = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            blocks.append(Block(text, main, chrome))

    def close(name: str) -> None:
        nonlocal main, chrome
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                main, chrome = stack[-1][1:] if stack else (False, False)
                return
            if name == "p" and stack[i][0] in _BLOCK:
                return

    at, lower = 0, None
    while m := _TAG.search(source, at):
        held.append(source[at:m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCK or name == "br":
            if name != "br":
                flush()
            else:
                held.append(" ")
        if m[1]:
            close(name)
            continue
        if name in _RAW:
            lower = lower if lower is not None else source.lower()
            end = lower.find(f"</{name}", at)
            at = len(source) if end < 0 else end
            continue
        if name in _BLOCK:
            close("p")
        if name in _VOID or m[3].endswith("/"):
            continue
        marks = {w for found in _NAMED.findall(m[3]) for w in re.split(r"[\s_-]+", "".join(found).lower())} if m[3] else ()
        furniture = name in _CHROME or name == "header" and not main or not _MARKS.isdisjoint(marks)
        if name in ("html", "body"):
            furniture = False
            close("head")
        main, chrome = main or name in _MAIN or "main" in marks and name != "body", chrome or furniture
        stack.append((name, main, chrome))
    held.append(source[at:])
    flush()
    return blocks


def repeated_runs(streams: list[list[str]], length: int, pages: int) -> list[np.ndarray]:
    """Which tokens of each stream lie in a run of ``length`` or more tokens found on ``pages`` or more streams.

    The streams are concatenated, each closed by separators of its own. Prefix doubling sorts all suffixes by
    their first ``length`` tokens (a power of two); suffixes of equal rank start the same run.
    """
    sizes = [len(s) for s in streams]
    total = sum(sizes) + length * len(streams)
    ranks, page = np.empty(total, np.int64), np.repeat(np.arange(len(streams)), np.array(sizes) + length)
    at = 0
    for s in streams:
        ranks[at:at + len(s)] = np.fromiter(map(hash, s), np.int64, len(s))
        ranks[at + len(s):at + len(s) + length] = hash(("end", at))
        at += len(s) + length
    ranks = np.unique(ranks, return_inverse=True)[1]
    step = 1
    while step < length:
        after = np.zeros(total, np.int64)
        after[:total - step] = ranks[step:] + 1
        ranks = np.unique(ranks * (total + 1) + after, return_inverse=True)[1]
        step *= 2
    order = np.lexsort((page, ranks))
    r, p = ranks[order], page[order]
    fresh = np.ones(total, np.int64)
    fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    common = np.bincount(r, weights=fresh)[ranks] >= pages      # distinct pages of each rank
    edge = np.zeros(total + 1, np.int64)
    starts = np.flatnonzero(common)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, total), -1)
    covered = np.cumsum(edge[:-1]) > 0
    out, at = [], 0
    for n in sizes:
        out.append(covered[at:at + n])
        at += n + length
    return out


def main_texts(pages: list[list[Block]], length: int = 8, most_pages: int = 3) -> list[str]:
    """The main text of each page, the pages being of one host.

    Blocks covered by repeated runs are boilerplate and the others stay; then the structure is consulted: a
    page with an article keeps all of it, copied or not, and nothing else, and page furniture never stays.
    """
    covered = repeated_runs([[w for b in blocks for w in b.text.split()] for blocks in pages], length, most_pages)
    return [page_text(blocks, marked) for blocks, marked in zip(pages, covered)]


def page_text(blocks: list[Block], marked: np.ndarray) -> str:
    """The main text of a page whose repeated tokens are ``marked``."""
    article = has_article(blocks)
    kept, at = [], 0
    for b in blocks:
        n = b.text.count(" ") + 1
        unique = 2 * int(marked[at:at + n].sum()) <= n
        at += n
        if not b.chrome and (b.main if article else unique):
            kept.append(b.text)
    return "\n".join(kept)


def has_article(blocks: list[Block]) -> bool:
    return any(b.main and not b.chrome for b in blocks)


def _fresh(values: np.ndarray, most: int = 1) -> np.ndarray:
    """The first ``most`` of each stretch of equal values."""
    fresh = np.ones(len(values), bool)
    fresh[most:] = values[most:] != values[:-most] if most else False
    return fresh


@dataclass(frozen=True)
class Suffixes:
    """The suffixes of a portion's pages, in page order. One shorter than ``length`` tokens begins no run and is none."""

    names: np.ndarray       # of all tokens of all pages: 64 bits each, equal in all processes
    hosts: np.ndarray       # of each page, a name as well
    starts: np.ndarray      # place in ``names`` of each page's first token, and the end
    at: np.ndarray          # place in ``names`` of each suffix
    page: np.ndarray        # of each suffix
    hashed: np.ndarray      # 64 bits of host and first ``length`` tokens of each suffix
    length: int

    def keys(self, some: np.ndarray) -> np.ndarray:
        """The host and the first tokens of ``some`` suffixes, as bytes that sort."""
        out = np.empty((len(some), self.length + 1), ">u8")
        out[:, 0] = self.hosts[self.page[some]]
        for k in range(self.length):
            out[:, k + 1] = self.names[self.at[some] + k]
        return out

    def marks(self, bits: int) -> np.ndarray:
        """Of each suffix ``bits`` bits of the least hash of its runs of ``length`` - 2 tokens, which every suffix that begins alike has too.

        Neighbours often have the same one, so a page has half as many marks as suffixes.
        """
        more = min(2, self.length - 1)
        each = _hashes(self.names, np.repeat(self.hosts, np.diff(self.starts)), self.length - more)
        return np.minimum.reduce([each[self.at + k] for k in range(more + 1)]) & np.uint64((1 << bits) - 1)

    def few(self, rows: np.ndarray, pages: int) -> tuple[np.ndarray, np.ndarray]:
        """Of ``rows``, sorted by hash: one a page for the first ``pages`` pages of a hash; and which are the first of their hash."""
        first = _fresh(self.hashed[rows])
        fresh = first | _fresh(self.page[rows])
        seen = np.cumsum(fresh)
        kept = fresh & (seen - np.repeat(seen[first], np.diff(np.append(np.flatnonzero(first), len(rows)))) < pages)
        return rows[kept], first[kept]


def _hashes(names: np.ndarray, hosts: np.ndarray, length: int) -> np.ndarray:
    """64 bits of host and ``length`` names at each place of ``hosts``."""
    hashed = hosts
    for k in range(length):
        hashed = (hashed ^ (hashed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + names[k:k + len(hosts)]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        hashed = (hashed ^ (hashed >> np.uint64(shift))) * np.uint64(factor)
    return hashed


def suffixes_of(hosts: list[str], texts: pa.ListArray, length: int) -> Suffixes:
    """The suffixes of pages: of each its host and the texts of its blocks, whose tokens have one blank between them."""
    from pandas.util import hash_array
    words = pc.split_pattern(texts.flatten(), " ")
    coded = words.flatten().dictionary_encode()
    named = hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    names = np.append(named[coded.indices.to_numpy()], np.zeros(length, np.uint64))
    blocks = texts.offsets.to_numpy()
    starts = np.append(0, np.cumsum(words.value_lengths().to_numpy(), dtype=np.int64))[blocks - blocks[0]]
    counts = np.maximum(0, np.diff(starts) - length + 1)
    page = np.repeat(np.arange(len(hosts)), counts)
    at = np.arange(counts.sum()) + np.repeat(starts[:-1] - np.append(0, np.cumsum(counts)[:-1]), counts)
    of = hash_array(np.array(hosts, object), categorize=False)
    return Suffixes(names, of, starts, at, page, _hashes(names, np.repeat(of, np.diff(starts)), length)[at], length)


def pack(values: np.ndarray, bits: int) -> bytes:
    """Sorted numbers of ``bits`` bits as an Elias-Fano sequence: about log2(2**bits / n) + 2 bits each."""
    n = len(values)
    low = max(0, bits - n.bit_length())
    high = np.zeros(n + (1 << (bits - low)), np.uint8)
    high[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    lows = (values >> np.arange(low, dtype=np.uint64)[:, None]).astype(np.uint8) & 1
    return n.to_bytes(4, "little") + np.packbits(high).tobytes() + np.packbits(lows).tobytes()


def unpack(packed: bytes, bits: int) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    low = max(0, bits - n.bit_length())
    size = n + (1 << (bits - low))
    raw = np.frombuffer(packed, np.uint8, offset=4)
    values = (np.flatnonzero(np.unpackbits(raw[:(size + 7) // 8], count=size)) - np.arange(n)).astype(np.uint64) << np.uint64(low)
    lows = np.unpackbits(raw[(size + 7) // 8:], count=low * n).reshape(low, n)
    return values + (np.uint64(1) << np.arange(low, dtype=np.uint64)) @ lows


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``known``, which is sorted. Most are not, as a small table of their last bits tells."""
    last = np.uint64((1 << (len(known).bit_length() + 4)) - 1)
    table = np.zeros(int(last) + 1, bool)
    table[(known & last).astype(np.int64)] = True
    found = table[(values & last).astype(np.int64)]
    some = np.flatnonzero(found)
    if len(some):
        found[some] = known[np.minimum(np.searchsorted(known, values[some]), len(known) - 1)] == values[some]
    return found


def shared_marks(batches: Iterator[pa.RecordBatch], bits: int, least_pages: int) -> Iterator[pa.RecordBatch]:
    """Which of each portion's marks are found on ``least_pages`` or more pages, given rows (range, portion, marks) ordered by range.

    ``marks`` are packed numbers of ``bits`` bits, one for each page that has it. All rows of a range meet here.
    """
    def found(number: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        marks = [unpack(m, bits) for _, m in rows]
        values = np.sort(np.concatenate(marks))
        repeated, out = values[least_pages - 1:][~_fresh(values, least_pages - 1)[least_pages - 1:]], []
        for (portion, _), own in zip(rows, marks):
            both = own[_among(own, repeated)]
            if len(both):
                out.append((portion, number, pack(both[_fresh(both)], bits)))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                                           pa.array([o[2] for o in out], pa.binary())], names=["portion", "range", "marks"])

    number, rows = None, []
    for batch in batches:
        for n, portion, marks in zip(*(batch.column(c).to_pylist() for c in ("range", "portion", "marks"))):
            if n != number and rows:
                yield found(number, rows)
                rows = []
            number = n
            rows.append((portion, marks))
    if rows:
        yield found(number, rows)


def repeated_neighbours(batches: Iterator[pa.RecordBatch], least_pages: int) -> Iterator[pa.RecordBatch]:
    """uid, place of the suffixes with ``bare`` set whose key is found on ``least_pages`` or more pages.

    The batches (key, uid, place, bare) are a stretch of the suffix array: ordered by key, then uid, so equal keys are neighbours.
    Of a key only the first rows are held, up to the page that makes it repeated, and bare ones at that.
    """
    key, page, pages, held = None, None, 0, []
    for batch in batches:
        keys, uids = batch.column("key").to_pylist(), batch.column("uid").to_pylist()
        places, bare = batch.column("place").to_pylist(), batch.column("bare").to_pylist()
        out: list[tuple[int, int]] = []
        for k, uid, place, asked in zip(keys, uids, places, bare):
            if k != key:
                key, page, pages, held = k, uid, 1, []
            elif uid != page:
                page, pages = uid, pages + 1
            if pages < least_pages:
                if asked:
                    held.append((uid, place))
                continue
            out += held
            held = []
            if asked:
                out.append((uid, place))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32())], names=["uid", "place"])


#: Characters of HTML in a portion.
PORTION = 1 << 23
#: Bits of uid that number the pages of a portion. A page counts as 64 characters more than it has, which bounds their number.
_PAGE_BITS = 20


def parsed_portions(pages: DataFrame, chunk: int) -> DataFrame:
    """portion, pages: the parsed pages of some ``PORTION`` characters of HTML together, as a compressed Arrow stream.

    Rows are put in order first, so that portions lost with an executor are made anew alike.
    """
    size = PORTION

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, held, chars = TaskContext.get().partitionId() << 20, [], 0

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_table(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["portion", "pages"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sources = [source or "" for source in batch.column("html").slice(at, chunk).to_pylist()]
                sums = np.cumsum([len(source) + 64 for source in sources])
                n = min(len(sources), int(np.searchsorted(sums, size - chars)) + 1)      # the page that fills the portion is its last
                part, parsed = batch.slice(at, n), [page_blocks(source) for source in sources[:n]]
                held.append(pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("page_id", "url", "host")),
                     pa.array([[b.text for b in blocks] for blocks in parsed], pa.list_(pa.string())),
                     pa.array([[b.main for b in blocks] for blocks in parsed], pa.list_(pa.bool_())),
                     pa.array([[b.chrome for b in blocks] for blocks in parsed], pa.list_(pa.bool_()))],
                    names=["page_id", "url", "host", "texts", "main", "chrome"]))
                at, chars = at + n, chars + int(sums[n - 1])
                if chars >= size:
                    yield packed()
                    number, chars = number + 1, 0
                    held.clear()
        if held:
            yield packed()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), url_host(F.col("url")).alias("host"))
    return rows.sortWithinPartitions("page_id", "url", "html").mapInArrow(parse, "portion bigint, pages binary").repartition("portion")


def _opened(batch: pa.RecordBatch, what: str | None = None) -> Iterator[tuple[int, pa.Table, pa.Array | None]]:
    """Number and pages of each portion of the batch, and its list ``what``; a null list is empty."""
    for row, portion in enumerate(batch.column("portion").to_pylist()):
        with pa.ipc.open_stream(batch.column("pages")[row].as_buffer()) as stream:
            yield portion, stream.read_all(), what and batch.column(what).slice(row, 1).flatten()


def repeated_suffixes(parsed: DataFrame, chars: int, least_pages: int, length: int) -> DataFrame:
    """portion, runs: for each portion of ``parsed`` the places of the suffixes that begin a repeated run, one for all equal ones.

    The suffixes are sorted twice, as in prefix doubling: first by a mark that suffixes which begin alike share
    (``Suffixes.marks``). Where a mark is found on fewer than ``least_pages`` pages, no suffix that has it begins a
    repeated run. Marks cross the network packed, those of a portion and range together. The suffixes of the other
    marks are sorted by host and tokens themselves, in ranges over all tasks. A portion sends equal suffixes of
    ``least_pages`` pages at most, which decide as well as all. ``chars``, the characters of HTML, sets the number of
    ranges and the bits of a mark; another number changes the work, but no result.
    """
    least_pages = max(1, least_pages)
    high = max(8, (chars >> 25).bit_length())       # bits of a range: some two million marks in each at most
    bits = min(max(high + 8, chars.bit_length() + 1), 64 - _PAGE_BITS)      # about five more than it takes to number all marks
    low = bits - high

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, pages, _ in _opened(batch):
                found = suffixes_of(pages["host"].to_pylist(), pages["texts"].combine_chunks(), length)
                both = np.sort(found.marks(bits) << np.uint64(_PAGE_BITS) | found.page.astype(np.uint64))
                mark = both[_fresh(both)] >> np.uint64(_PAGE_BITS)      # one a page
                mark = mark[_fresh(mark, least_pages)]
                numbers = mark >> np.uint64(low)
                edges = np.append(np.flatnonzero(_fresh(numbers)), len(numbers))
                packed = [pack(mark[i:j] & np.uint64((1 << low) - 1), low) for i, j in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(numbers[edges[:-1]].astype(np.int64)), pa.array([portion] * len(packed), pa.int64()),
                                                  pa.array(packed, pa.binary())], names=["range", "portion", "marks"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shared_marks(batches, low, least_pages)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion, pages, shared in _opened(batch, "shared"):
                found = suffixes_of(pages["host"].to_pylist(), pages["texts"].combine_chunks(), length)
                known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpack(m["marks"], low) + np.uint64(m["range"] << low) for m in shared.to_pylist())]))
                rows = np.flatnonzero(_among(found.marks(bits), known))
                kept, first = found.few(rows[np.argsort(found.hashed[rows], kind="stable")], least_pages)
                order = np.argsort(kept)      # neighbours on a page share tokens, which compresses
                kept, first = kept[order], first[order]
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * length + 8), len(kept), [None, pa.py_buffer(found.keys(kept).tobytes())])
                out = pa.RecordBatch.from_arrays([keys.cast(pa.binary()), pa.array((portion << _PAGE_BITS) + found.page[kept]),
                                                  pa.array(found.at[kept].astype(np.int32)), pa.array(first)], names=["key", "uid", "place", "bare"])
                yield from (out.slice(k, 1 << 16) for k in range(0, len(kept), 1 << 16))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return repeated_neighbours(batches, least_pages)

    marked = parsed.mapInArrow(marks, "range bigint, portion bigint, marks binary").repartition("range").sortWithinPartitions("range")
    known = marked.mapInArrow(shared, "portion bigint, range bigint, marks binary").groupBy("portion").agg(F.collect_list(F.struct("range", "marks")).alias("shared"))
    # a left join, as an inner one would filter the portions before their shuffle and so shuffle them anew
    array = parsed.join(known, "portion", "left").mapInArrow(suffixes, "key binary, uid bigint, place int, bare boolean")
    runs = array.repartitionByRange("key").sortWithinPartitions("key", "uid", "place").mapInArrow(repeated, "uid bigint, place int")
    return runs.groupBy(F.shiftright("uid", _PAGE_BITS).alias("portion")).agg(F.collect_list("place").alias("runs"))


def covered_tokens(found: Suffixes, places: np.ndarray) -> list[np.ndarray]:
    """Which tokens of each page lie in a run that a suffix begins which equals one of those at ``places``."""
    begins = _among(found.hashed, np.sort(found.hashed[np.searchsorted(found.at, places)]))
    edge = np.bincount(found.at[begins], minlength=len(found.names) + 1)
    edge[found.length:] -= edge[:-found.length].copy()
    covered = np.cumsum(edge) > 0
    return [covered[i:j] for i, j in zip(found.starts[:-1], found.starts[1:])]


def extract_text(pages: DataFrame, chunk: int = 256, least_pages: int = 3, length: int = 8) -> DataFrame:
    """page_id, url, text, n_chars for each of ``pages`` (page_id, url, html).

    Pages are parsed once, ``chunk`` at a time, and dealt to tasks in portions. The suffixes of all pages, with an article
    or without, are put in one array, ordered by host and first ``length`` tokens (``repeated_suffixes``). Suffixes that share
    them are neighbours in it; those of ``least_pages`` or more pages begin a repeated run. The array is sorted by ranges
    over all tasks, so no host meets in one. A null html or url is empty. Repeated rows stay; an empty table gives no rows.
    """
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, table, runs in _opened(batch, "runs"):
                found = suffixes_of(table["host"].to_pylist(), table["texts"].combine_chunks(), length)
                texts = table["texts"].to_pylist()
                marked = covered_tokens(found, runs.to_numpy())
                for k in range(0, len(texts), chunk):
                    part = table.slice(k, chunk)
                    out = [page_text([Block(*b) for b in zip(*page)], marks) for *page, marks in
                           zip(texts[k:k + chunk], part["main"].to_pylist(), part["chrome"].to_pylist(), marked[k:k + chunk])]
                    yield pa.RecordBatch.from_arrays([part["page_id"].combine_chunks(), part["url"].combine_chunks(), pa.array(out, pa.string()),
                                                      pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chars = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")))).first()[0] or 0
    parsed = parsed_portions(pages, chunk)
    return parsed.join(repeated_suffixes(parsed, chars, least_pages, length), "portion", "left").select("portion", "pages", "runs").mapInArrow(
        finish, "page_id bigint, url string, text string, n_chars bigint")
