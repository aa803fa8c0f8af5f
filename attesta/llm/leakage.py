"""Held-out test items inside corpus documents, by q-gram counts in diagonal bands.

The corpus is read once, whatever the number of items: a filter of fixed size drops the places
whose q-grams no item has, and places without enough others near them. What stays meets the
items by an equi-join on q-grams, on the rarest ones of each item's windows only (or of its
runs of whole words), of which a shared region must hold one; so a q-gram that all items share isn't expanded. For each pair
that met, the q-grams are counted in overlapping bands of diagonals: a window of L characters
with at most e edits keeps at least L - q + 1 - q * e of them within a band of e + 1 diagonals
(the q-gram lemma). Each window that a band retains is verified by banded alignment on its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.filters import in_filter, key_filter
from attesta.session import settle, spread

#: Characters whose q-grams are hashed together, and rows' characters that are taken together.
BLOCK = 1 << 20
#: Pairs of places that are held at once when the q-grams of two texts meet.
EXPANDED = 1 << 22
#: How many of its chosen q-grams a pair must share to be looked at; the more, the more are chosen.
NEED = 40
MIX = np.uint64(0x9E3779B97F4A7C15)
END, SPACE = 1, 32


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Lower case and whether it's a letter or digit, for the characters of the first plane."""
    lower, word = np.arange(1 << 16, dtype=np.uint32), np.zeros(1 << 16, bool)
    for c in range(1 << 16):
        word[c], lower[c] = _class(c)
    return lower, word


def _class(c: int) -> tuple[bool, int]:
    category, low = unicodedata.category(chr(c)), chr(c).lower()
    return category[0] == "L" or category == "Nd", ord(low) if len(low) == 1 else c


def words_only(texts: list[str]) -> np.ndarray:
    """Code points of the texts' words in lower case, a space before and after each, END before, between and after the texts."""
    lower, word = _classes()
    raw = np.frombuffer(("\x01\n" + "\n\x01\n".join(t.replace("\x01", " ") for t in texts) + "\n\x01").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = raw & np.uint32(0xFFFF)
    code, kept = lower[low], word[low]
    for at in np.flatnonzero(raw > 0xFFFF):
        kept[at], code[at] = _class(int(raw[at]))
    code = np.where(kept, code, np.uint32(SPACE))
    code[raw == END] = END
    blank = code == SPACE
    return code[~(blank & np.concatenate([[False], blank[:-1]]))]


def folded(codes: np.ndarray) -> np.ndarray:
    """A byte for each character; characters beyond ASCII share bytes, which only adds candidates."""
    return np.where(codes < 128, codes, 128 + ((codes * np.uint32(40503)) >> np.uint32(7)) % np.uint32(128)).astype(np.uint8)


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit value for each run of q bytes (q from 8 to 16); exact at q = 8."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    wide = four[:-4].astype(np.uint64) << np.uint64(32) | four[4:]
    if q == 8:
        return wide * MIX
    n = len(data) - q + 1
    tail = wide[q - 8 : q - 8 + n] * MIX
    return (wide[:n] ^ (tail ^ (tail >> np.uint64(29)))) * MIX


def crowded(at: np.ndarray, least: int, span: int) -> np.ndarray:
    """Which positions lie in some window of ``span`` with ``least`` positions or more."""
    if len(at) < least:
        return np.zeros(len(at), bool)
    full = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= span)
    edge = np.zeros(len(at) + 1, np.int64)
    np.add.at(edge, full, 1)
    np.add.at(edge, full + least, -1)
    return np.cumsum(edge[:-1]) > 0


def rarest(frequency: np.ndarray, width: int, least: int, need: int = 1) -> np.ndarray:
    """Places of an item of which any ``least`` of each window of ``width`` include ``need``: the window's rarest."""
    n = len(frequency)
    if n < least:
        return np.empty(0, np.int64)
    width = min(width, n)
    chosen = np.zeros(n, bool)
    rank = np.lexsort((np.arange(n), frequency)).argsort()
    for begin in range(0, n - width + 1, 1 << 14):
        view = np.lib.stride_tricks.sliding_window_view(rank[begin : begin + (1 << 14) + width - 1], width)
        many = width - least + need
        part = np.argpartition(view, many - 1, axis=1)[:, :many]
        chosen[(part + np.arange(begin, begin + len(view))[:, None]).ravel()] = True
    return np.flatnonzero(chosen)


def rarest_of_runs(frequency: np.ndarray, codes: np.ndarray, words: int, q: int) -> np.ndarray:
    """Places of which each run of so many whole words, which must be shared in full, includes one: the run's rarest."""
    spaces = np.flatnonzero(codes == SPACE)
    first, last = spaces[:-words], spaces[words:] - q + 1
    rank = np.lexsort((np.arange(len(frequency)), frequency)).argsort()
    chosen: set[int] = set()
    best, at = -1, -1
    for lo, hi in zip(first.tolist(), last.tolist()):
        if best < lo:
            best = lo + int(rank[lo : hi + 1].argmin())
        else:
            fresh = at + 1 + int(rank[at + 1 : hi + 1].argmin()) if hi > at else best
            best = fresh if rank[fresh] < rank[best] else best
        at = hi
        chosen.add(best)
    return np.array(sorted(chosen), np.int64)


def retained(pos: np.ndarray, diagonal: np.ndarray, length: int, budget: int, q: int) -> list[tuple[int, int, int]]:
    """(low diagonal, first start, last start) of the windows that meet the lemma's bound.

    Bands are budget + max(1, budget) diagonals wide and start every max(1, budget), so any
    budget + 1 neighbouring diagonals lie together in one band.
    """
    least, step = length - q + 1 - q * budget, max(1, budget)
    assert least > 0, "the edit budget leaves no q-gram to count"
    band = np.floor_divide(diagonal, step)
    if budget:
        pos, band = np.tile(pos, 2), np.concatenate([band, band - 1])
    order = np.lexsort((pos, band))
    pos, band = pos[order], band[order]
    fresh = np.ones(len(pos), bool)
    fresh[1:] = (pos[1:] != pos[:-1]) | (band[1:] != band[:-1])
    pos, band = pos[fresh], band[fresh]
    if len(pos) < least:
        return []
    head, tail = pos[: len(pos) - least + 1], pos[least - 1 :]
    full = np.flatnonzero((band[: len(head)] == band[least - 1 :]) & (tail - head <= length - q))
    low, first, last = band[full] * step, tail[full] - (length - q), head[full]
    begins = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (first[1:] > last[:-1] + 1)])) if len(full) else full
    ends = np.concatenate([begins[1:], [len(full)]])[: len(begins)] - 1
    return list(zip(low[begins].tolist(), first[begins].tolist(), last[ends].tolist()))


def banded_alignment(doc: np.ndarray, item: np.ndarray, starts: np.ndarray, length: int, low: int, high: int) -> np.ndarray:
    """Fewest edits that turn ``length`` characters of ``doc`` from each start into some stretch of
    ``item``, with every place of the alignment on a diagonal (doc's index less item's) from low to high."""
    if low == high:  # one diagonal: no characters are left out
        first, end = max(0, low), min(len(doc), len(item) + low)
        differ = np.ones(len(doc) + 1, np.int64)
        differ[0], differ[1 + first : 1 + end] = 0, doc[first:end] != item[first - low : end - low]
        upto = np.cumsum(differ)
        return upto[starts + length] - upto[starts]
    far, lanes = length + 1, np.arange(low, high + 1)
    padded = np.concatenate([np.zeros(1, np.uint32), item, np.zeros(1, np.uint32)])
    place = starts[:, None] - lanes[None, :]  # item's next character
    cost = np.where((place >= 0) & (place <= len(item)), 0, far).astype(np.int16)
    ahead = np.arange(len(lanes), dtype=np.int16)
    for _ in range(length):
        inside = (place >= 0) & (place < len(item))
        best = np.where(inside, cost + (padded[np.clip(place, -1, len(item)) + 1] != doc[starts][:, None]), far).astype(np.int16)  # match or replace
        best[:, 1:] = np.minimum(best[:, 1:], cost[:, :-1] + 1)  # a character of doc alone
        place, starts = place + 1, starts + 1
        valid = (place >= 0) & (place <= len(item))
        best[~valid] = far
        cost = np.minimum.accumulate((best + ahead)[:, ::-1], axis=1)[:, ::-1] - ahead  # characters of item alone
        cost[~valid] = far
        np.minimum(cost, far, out=cost)
    return cost.min(axis=1)


def whole_words(a: np.ndarray, b: np.ndarray, at: int, diagonal: int) -> int:
    """Words in the longest equal run through a[at] and b[at - diagonal], cut words left out."""
    lo, hi = at, at
    first = max(0, diagonal)
    differ = np.flatnonzero(a[first:at] != b[first - diagonal : at - diagonal])
    lo = first + int(differ[-1]) + 1 if len(differ) else first
    end = min(len(a), len(b) + diagonal)
    differ = np.flatnonzero(a[hi:end] != b[hi - diagonal : end - diagonal])
    hi = hi + int(differ[0]) if len(differ) else end
    return int((a[lo:hi] == SPACE).sum()) - 1


def _met(own: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, place) of equal values, in pieces of bounded size; positions ascend from piece to piece."""
    order = np.argsort(other, kind="stable")
    ranked = other[order]
    start, stop = np.searchsorted(ranked, own), np.searchsorted(ranked, own, "right")
    each = stop - start
    at = np.flatnonzero(each)
    total = np.cumsum(each[at])
    for begin in range(0, int(total[-1]) if len(at) else 0, EXPANDED):
        part = at[(total > begin) & (total - each[at] < begin + EXPANDED)] if total[-1] > EXPANDED else at
        pos = np.repeat(part, each[part])
        within = np.arange(len(pos)) - np.repeat(np.cumsum(each[part]) - each[part], each[part])
        yield pos, order[np.repeat(start[part], each[part]) + within]


def verified(doc: np.ndarray, item: np.ndarray, length: int, budget: int, q: int, words: int) -> tuple[int, int] | None:
    """(characters, edits) of the longest stretch of ``doc`` whose every window of ``length`` stands in
    ``item`` within the budget, and of the best window; with ``words`` only if so many words are shared."""
    mine, other = gram_hashes(folded(doc), q), gram_hashes(folded(item), q)
    accepted = np.full(max(0, len(doc) - length + 1), length + 1)
    reach = length + budget
    before: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64))
    for pos, place in _met(mine, other):
        near = before[0] >= pos[0] - reach  # a window may begin in a piece before
        before = pos, place = np.concatenate([before[0][near], pos]), np.concatenate([before[1][near], place])
        for low, first, last in retained(pos, pos - place, length, budget, q):
            for begin in range(max(0, first), min(last, len(accepted) - 1) + 1, 4096):
                starts = np.arange(begin, min(begin + 4096, last + 1, len(accepted)))
                for d in range(low, low + 2 * budget):  # equal stretches need no alignment
                    starts = starts[accepted[starts] > 0]
                    accepted[starts[banded_alignment(doc, item, starts, length, d, d) == 0]] = 0
                starts = starts[accepted[starts] > 0] if not words else starts
                if not len(starts):
                    continue
                edits = banded_alignment(doc, item, starts, length, low - budget, low + max(1, 2 * budget) - 1 + budget)
                accepted[starts] = np.minimum(accepted[starts], edits)
                good = starts[edits <= budget]
                if words and any(whole_words(doc, item, int(s), low) >= words for s in good[np.diff(good, prepend=-2) > 1]):
                    return length, 0
    good = np.flatnonzero(accepted <= budget)
    if words or not len(good):
        return None
    runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
    return length + max(len(r) for r in runs) - 1, int(accepted[good].min())


def _grams(q: int):
    """(item_id, text) to (item_id, words, grams), the normalised text and its q-grams in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [words_only([t])[1:-1] for t in batch.column(1).to_pylist()]
            texts = pa.array([c.tobytes().decode("utf-32-le", "surrogatepass") for c in codes], pa.string())
            grams = pa.array([gram_hashes(folded(c), q).view(np.int64) for c in codes], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, grams], ["item_id", "words", "grams"])

    return run


def _chosen(width: int, least: int, need: int, q: int, words: int):
    """(item_id, text, its q-grams with their frequencies) to (item_id, key, places) of the rarest q-grams of each window, and how often each was chosen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, often = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for item, text, rows in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = sorted((r["at"], r["key"], r["n"]) for r in rows)
                frequency = np.array([r[2] for r in rows])
                places = rarest_of_runs(frequency, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), words, q) if words else rarest(frequency, width, least, need)
                found, times = np.unique(np.array([r[1] for r in rows], np.int64)[places], return_counts=True)
                ids += [item] * len(found)
                keys.append(found)
                often.append(times)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(keys)), pa.array(np.concatenate(often))], ["item_id", "key", "places"])

    return run


def stretches(every: bytes, chosen: bytes, length: int, budget: int, q: int):
    """(doc_id, text) to the stretches of documents that hold enough q-grams of items near each
    other: (doc_id, place, words, keys), the keys being those that were chosen for the join."""
    least = length - q + 1 - q * budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, wanted = np.frombuffer(every, np.uint8), np.frombuffer(chosen, np.uint8)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            docs, places, words, keys = [], [], [], []
            sizes = np.cumsum([len(t) for t in texts])
            for group in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // BLOCK)) + 1):
                codes = words_only([texts[i] for i in group])
                data = folded(codes)
                hit, value = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
                for begin in range(0, len(data), BLOCK):
                    values = gram_hashes(data[begin : begin + BLOCK + q - 1], q)
                    at = np.flatnonzero(in_filter(there, values))
                    hit.append(at + begin)
                    value.append(values[at])
                at, values = np.concatenate(hit), np.concatenate(value)
                near = crowded(at, least, length - q)
                at, values = at[near], values[near]
                ends = np.flatnonzero(codes == END)
                owner = np.searchsorted(ends, at) - 1
                for part in np.split(np.arange(len(at)), np.flatnonzero((np.diff(at) > length) | (np.diff(owner) > 0)) + 1) if len(at) else []:
                    found = np.unique(values[part][in_filter(wanted, values[part])])
                    if len(part) < least or not len(found):
                        continue
                    k = owner[part[0]]
                    lo, hi = max(ends[k] + 1, at[part[0]] - length), min(ends[k + 1], at[part[-1]] + q + length)
                    docs.append(ids[group[k]])
                    places.append(int(lo - ends[k] - 1))
                    words.append(codes[lo:hi].tobytes().decode("utf-32-le", "surrogatepass"))
                    keys.append(found.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(places, pa.int64()), pa.array(words, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "place", "words", "keys"])

    return run


def _verified(length: int, budget: int, q: int, words: int):
    """(doc_id, stretch, item_id, item) to (doc_id, item_id, chars, edits) of the pairs that stand the alignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, stretch, item, other in zip(*(batch.column(k).to_pylist() for k in range(4))):
                a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (stretch, other))
                found = verified(a, b, length, budget, q, words)
                if found:
                    rows.append((doc, item, *found))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "item_id", "chars", "edits"])

    return run


def leaks(documents: DataFrame, items: DataFrame, length: int, budget: int, q: int, words: int = 0) -> DataFrame:
    """(doc_id, item_id, chars, edits): items of which a window of ``length`` characters of a
    document stands in the item with at most ``budget`` edits.

    Characters are those of the words in lower case with single spaces between them. ``chars``
    is the longest stretch of the document all of whose windows do, ``edits`` the fewest of
    any window; with ``words`` a pair must share a run of so many whole words. documents:
    doc_id, text; items: item_id, text, one row per id. Null and empty texts hold nothing.
    The corpus is mapped once and only its stretches that look like items are shuffled; what
    is sent to the tasks are two filters of fixed size.
    """
    least = length - q + 1 - q * budget
    need = 1 if words else min(NEED, least)  # of so many of the rarest a shared window holds this many
    known = settle(items.where("text is not null and item_id is not null").select("item_id", "text").transform(spread).mapInArrow(_grams(q), "item_id long, words string, grams array<long>"))
    grams = known.select("item_id", F.posexplode("grams").alias("at", "key"))
    often = grams.groupBy("key").agg(F.count_distinct("item_id").alias("n"))
    chosen = settle(
        grams.join(often, "key").groupBy("item_id").agg(F.collect_list(F.struct("at", "key", "n")).alias("rows"))
        .join(known.select("item_id", "words"), "item_id").select("item_id", "words", "rows")
        .mapInArrow(_chosen(length - q + 1 + budget, least, need, q, words), "item_id long, key long, places long")
    )
    corpus = documents.where("text is not null and doc_id is not null").select("doc_id", "text").where(F.length("text") >= length - 2)
    scan = stretches(key_filter(often), key_filter(chosen.select("key").distinct()), length, budget, q)
    found = settle(corpus.mapInArrow(scan, "doc_id long, place long, words string, keys array<long>"))
    pairs = found.select("doc_id", "place", F.explode("keys").alias("key")).join(chosen, "key").groupBy("doc_id", "place", "item_id").agg(F.sum("places").alias("met")).where(F.col("met") >= need)
    whole = pairs.join(found.select("doc_id", "place", "words"), ["doc_id", "place"]).join(known.select("item_id", F.col("words").alias("item")), "item_id")
    checked = whole.select("doc_id", "words", "item_id", "item").transform(spread).mapInArrow(_verified(length, budget, q, words), "doc_id long, item_id long, chars long, edits long")
    return checked.groupBy("doc_id", "item_id").agg(F.max("chars").alias("chars"), F.min("edits").alias("edits"))


def shared_runs(documents: DataFrame, items: DataFrame, words: int = 12) -> DataFrame:
    """(doc_id, item_id) of texts that share ``words`` or more consecutive words.

    Such a run has at least 2 * words + 1 characters with the spaces around its words, on one
    diagonal and without edits; every pair with a window of that length that meets the q-gram
    bound and the alignment with an edit budget of 0 has its common words counted exactly.
    """
    length = 2 * words + 1
    return leaks(documents, items, length, 0, min(16, length - 4), words).select("doc_id", "item_id").distinct()
