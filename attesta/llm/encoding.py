"""Texts decoded with the wrong character encoding: found, explained and restored.

Records (words and sentences) are joined with their twins on the text without its non-ASCII
characters, whose places are kept. The most frequent twin counts as clean; the characters that
differ are aligned between the common ASCII ones. What is learned from the aligned pairs are
transformations: a pair of encodings where one turns the clean characters into the others,
which then holds for characters not seen yet; else a table of what stands for what, so that
encodings nobody listed are learned too; and the loss of characters. They are then applied to
all remaining records, where undoing one must make the text more orderly: fewer mixed scripts,
capitals inside words, and signs between letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.filters import in_filter, key_filter
from attesta.session import settle, spread

# Encodings that texts are written in, and read in by mistake.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "cp866", "koi8-r", "cp850", "cp437", "mac_roman", "iso8859-5", "mac_cyrillic", "cp1254", "iso8859-2")
READ = ("cp1252", "latin-1", "cp1250", "cp1251", "cp866", "koi8-r", "cp850", "cp437", "mac_roman", "iso8859-5", "mac_cyrillic", "cp1254", "iso8859-2")
CHAINS = tuple(f"{a}>{b}" for a in WRITTEN for b in READ if a != b and {a, b} != {"cp1252", "latin-1"})
#: Characters that were lost on reading stand as this one; what they were only a twin can say.
LOST, LOSS = "\ufffd", "lost"
HIGH = re.compile(r"[^\x00-\x7f]+")
# Only ASCII blanks part words: U+0085 and U+00A0 may be the second half of a garbled letter.
WORD = re.compile(r"[^ \t\r\n]+")
ORDER = {c: k for k, c in enumerate((*CHAINS, LOSS))}
LETTER = re.compile(r"[A-Za-z]")
#: Signs that stand inside or next to words of ordinary text.
ORDINARY = set("’‘“”„«»‹›–—‐‑…·•→←↑↓≤≥≠×÷±°€£¥§©®™№¿¡′″✓✔✗⚠ªº²³¹¼½¾µ\u00a0\u200b\ufeff\ufe0f")
#: Of those, signs that may end a word or join its parts, but don't go on with other signs or letters.
JOINING = set("’‘‐‑–—·\u200b\ufeff\ufe0f\u00a0")
#: What the first half of a letter in UTF-8 is mostly read as.
LEADS = set("ÂÃÄÅÐÑ")
MISPLACED = set("€£¥©®™°±§×÷¿¡„“‹«")


@lru_cache(maxsize=64)
def _tables(name: str) -> tuple[dict[str, int], list[str]]:
    """Byte of each character and character of each byte; undefined bytes are C1 controls."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    back: dict[str, int] = {}
    for b, c in enumerate(chars):
        back.setdefault(c, b)
    return back, chars


def _write(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    back = _tables(name)[0]
    out = [back.get(c) for c in text]
    return None if None in out else bytes(out)


def _read(data: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return None
    chars = _tables(name)[1]
    return "".join(chars[b] for b in data)


class Table:
    """A learned transformation: which characters stand for which ones."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.entries = entries
        self.pattern = re.compile("|".join(map(re.escape, sorted(entries, key=lambda g: (-len(g), g)))))

    def undo(self, text: str) -> str:
        """``text`` with the garbled characters of the table replaced; others stay."""
        return self.pattern.sub(lambda m: self.entries[m.group()], text)


@lru_cache(maxsize=1 << 17)
def garble(text: str, chain: str) -> str | None:
    """``text`` written in the chain's first encoding and read in its second; null if it can't be."""
    a, b = chain.split(">")
    data = _write(text, a)
    return None if data is None else _read(data, b)


@lru_cache(maxsize=1 << 17)
def undo(text: str, chain: str | Table) -> str | None:
    if isinstance(chain, Table):
        return chain.undo(text)
    a, b = chain.split(">")
    data = _write(text, b)
    return None if data is None else _read(data, a)


def align(form: str, twin: str) -> list[tuple[str, str]] | None:
    """Pairs of non-ASCII stretches between the same ASCII ones; null if they don't line up."""
    if HIGH.sub("\0", form) != HIGH.sub("\0", twin):
        return None
    return list(zip(HIGH.findall(form), HIGH.findall(twin)))


@lru_cache(maxsize=1 << 16)
def _chains_of(garbled: str, clean: str) -> frozenset[str]:
    """Chains that turn one stretch into the other, once or (from UTF-8) twice over."""
    found = set()
    for chain in CHAINS:
        once = garble(clean, chain)
        if once == garbled or once is not None and chain.startswith("utf-8") and garble(once, chain) == garbled:
            found.add(chain)
    if LOST in garbled and LOST not in clean:
        found.add(LOSS)
    return frozenset(found)


def explain(form: str, twin: str) -> list[str]:
    """Transformations that turn the twin's stretches into the form's."""
    pairs = [(g, c) for g, c in align(form, twin) or [] if g != c]
    return sorted(frozenset.intersection(*(_chains_of(g, c) for g, c in pairs))) if pairs else []


def entries(form: str, twin: str) -> list[tuple[str, str]]:
    """(garbled characters, clean character) of twins that no known transformation explains.

    The form must be disorderly and the twin not. In a stretch all clean characters must have become
    equally many, else only stretches of one character can be told apart.
    """
    pairs = [(g, c) for g, c in align(form, twin) or [] if g != c]
    if not pairs or any(LOST in g + c for g, c in pairs) or any(map(disorder, twin.split())) or not any(map(disorder, WORD.findall(form))):
        return []
    out = set()
    for garbled, clean in pairs:
        each, rest = divmod(len(garbled), len(clean))
        if not rest and each:
            out |= {(garbled[i * each : (i + 1) * each], c) for i, c in enumerate(clean)}
    return sorted((g, c) for g, c in out if g != c)


@lru_cache(maxsize=65536)
def _kind(c: str) -> str:
    """Class of a character: a letter's script and case, an ordinary sign, or an odd one."""
    if c < "\x80":
        return ("u" if c.isupper() else "l") + "L" if c.isalpha() else "d" if c.isdigit() else "s"
    if c in ORDINARY:
        return "s"
    category = unicodedata.category(c)
    if category[0] == "L":
        name = unicodedata.name(c, "?")
        script = {"LATI": "L", "CYRI": "C", "GREE": "G"}.get(name[:4], "O")
        if script == "L" and not ("À" <= c <= "ɏ" or "Ḁ" <= c <= "ỿ"):
            return "x"
        return ("u" if category == "Lu" else "l") + script
    if "\u2500" <= c <= "\u259f":
        return "b"
    if "\u2200" <= c <= "\u22ff":
        return "m"
    if category in ("Cc", "Co", "Cn", "Cf", "Sk", "Lm", "Zs") or c <= "\u00bf" or c in "†‡‰ˆ˜ƒ¸":
        return "x"
    return "s"


@lru_cache(maxsize=1 << 17)
def disorder(word: str) -> int:
    """How many places of a word don't occur in orderly text."""
    kinds = [_kind(c) for c in word]
    score = 0
    run = 0
    for i, (c, k) in enumerate(zip(word, kinds)):
        before, after = kinds[i - 1] if i else "", kinds[i + 1] if i + 1 < len(kinds) else ""
        letter = len(k) == 2
        if letter and len(before) == 2:
            score += 2 * (k[1] != before[1])  # two scripts in a word
            score += k[1] == before[1] and k[0] == "u" and before[0] == "l" and (c > "\x7f" or word[i - 1] > "\x7f")  # a capital inside
        if not (letter and k[1] == "L" and c > "\x7f"):
            run = 0
        elif not i or c != word[i - 1]:
            run += 1
        score += run >= 3
        if c > "\x7f":
            if k == "x":
                score += 2
            elif k == "b" and (len(before) == 2 or len(after) == 2):
                score += 1
            elif k == "m" and (len(before) == 2 or after and word[i + 1] > "\x7f"):
                score += 1
            elif c == "\u00a0" and i and word[i - 1] in LEADS:
                score += i < 2 or kinds[i - 2][0] != "u"  # as in "Ã\u00a0" for "à", not at the end of "IRMÃ"
            elif k == "s" and len(before) == 2 and c not in JOINING:
                score += len(after) == 2 or c in MISPLACED and after != "" and word[i + 1] > "\x7f"
    return score


SENTENCE = re.compile(r"(\n+|(?<=[.!?;:])[ \t]+)")


def repair(text: str, chains: tuple[str | Table, ...], depth: int = 2) -> tuple[str, int]:
    """The text with each sentence's garbled words restored, and how much order that brings.

    Of the chains, the one that lessens a sentence's disorder most is undone in all its words
    that don't get worse; stretches that it can't have produced stay as they are.
    """
    return repair_parts(SENTENCE.split(text), chains, depth)


def repair_parts(parts: list[str], chains: tuple[str | Table, ...], depth: int = 2) -> tuple[str, int]:
    """The same for a text's sentences and what parts them, in turn."""
    total = 0
    parts = list(parts)
    for i in range(0, len(parts), 2):
        part = parts[i]
        for _ in range(depth):
            if part.isascii():
                break
            words = [w for w in WORD.findall(part) if not w.isascii()]
            scores = {w: disorder(w) for w in set(words)}
            if not any(scores.values()):
                break
            best, gain, size, fix = "", 0, 0, {}
            for chain in chains:
                tried = {w: HIGH.sub(lambda m: (undo(m.group(), chain) or m.group()), w) for w in scores}
                kept = {w: f for w, f in tried.items() if f != w and disorder(f) <= scores[w] and (isinstance(chain, Table) or chain.startswith("utf-8") or _better(w, f))}
                alone = isinstance(chain, Table)  # then a sign by itself speaks for nothing, but is undone beside words that do
                won = sum(scores[w] - disorder(kept[w]) for w in words if w in kept and not (alone and not LETTER.search(w)))
                length = sum(map(len, kept.values())) - sum(map(len, (scores.keys() & kept.keys())))
                if won > gain or won == gain > 0 and length < size:
                    best, gain, size, fix = chain, won, length, kept
            if not best:
                break
            part = WORD.sub(lambda m: fix.get(m.group(), m.group()), part)
            total += gain
        parts[i] = part
    return "".join(parts), total


def _better(word: str, fixed: str) -> bool:
    """For one byte a character: the fixed word is of one script and without odd signs."""
    kinds = {_kind(c)[-1] for c in fixed if c > "\x7f"}
    return not kinds & {"x", "G", "O", "b"} and len({k for k in kinds if k in "LC"}) <= 1


NON_ASCII = r"[^\x00-\x7f]"


def forms(documents: DataFrame) -> DataFrame:
    """(doc_id, form, key): words and sentences with non-ASCII characters.

    key is a digest of the form with each stretch of them as one mark; words need two ASCII
    letters and sentences four, so that unrelated texts in another script don't meet.
    """
    text = documents.where("text is not null and doc_id is not null").where(F.col("text").rlike(NON_ASCII)).select("doc_id", "text")

    def letters(form):
        return F.length(F.regexp_replace(form, "[^A-Za-z]+", ""))

    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![^ \t\r\n])[!-~]*+[^\x00-\x7f][^ \t\r\n]*+"), F.lit(0))), lambda w: letters(w) >= 2)
    sentences = F.filter(F.array_distinct(F.split("text", r"\n+|(?<=[.!?;:])[ \t]+")), lambda x: x.rlike(NON_ASCII) & (letters(x) >= 4))
    key = F.xxhash64(F.regexp_replace("form", NON_ASCII + "+", "\0"))
    return text.select("doc_id", F.explode(F.array_union(words, sentences)).alias("form")).select("doc_id", "form", key.alias("key"))


def twins(found: DataFrame, margin: int = 3) -> DataFrame:
    """(form, n, twin, m): each rarer form of a key beside its most frequent one and all that are ``margin`` times as frequent as it.

    Counting comes first, so a form in a third of all documents is one row, and so does the
    choice of a key's most frequent form, which combines before the shuffle.
    """
    counted = found.groupBy("key", "form").agg(F.count(F.lit(1)).alias("n")).withColumn("high", F.length(F.regexp_replace("form", r"[\x00-\x7f]+", "")))
    top = counted.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.min(F.struct(-F.col("n"), "high", "form")).alias("top")).where("forms > 1")
    several = settle(counted.join(top.select("key", F.col("top.form").alias("first")), "key"))
    twin = several.where((F.col("form") == F.col("first")) | (F.col("n") >= margin)).select("key", F.col("form").alias("twin"), F.col("n").alias("m"), (F.col("form") == F.col("first")).alias("leads"))
    return several.join(twin, "key").where("form <> twin").where(F.col("leads") | (F.col("m") >= margin * F.col("n"))).select("form", "n", "twin", "m")


KNOWN = "form string, key long, n long, m long, chains array<string>, entries array<struct<garbled: string, clean: string>>"


def _explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pair = pa.list_(pa.struct([("garbled", pa.string()), ("clean", pa.string())]))
    for batch in batches:
        rows = []
        for form, n, twin, m in zip(*(batch.column(k).to_pylist() for k in range(4))):
            chains = explain(form, twin)
            table = [] if chains else entries(form, twin)
            if chains or table:
                rows.append((form, xxhash.xxh3_64_intdigest(form), n, m, chains, [{"garbled": g, "clean": c} for g, c in table]))
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64))]
        columns += [pa.array([r[k] for r in rows], t) for k, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.list_(pa.string())), (5, pair))]
        yield pa.RecordBatch.from_arrays(columns, ["form", "key", "n", "m", "chains", "entries"])


def explained(pairs: DataFrame) -> DataFrame:
    """(form, its digest, n, m, chains, entries) of the twins that some transformation explains, or that a table might."""
    return spread(pairs).mapInArrow(_explained, KNOWN)


def learned_tables(known: DataFrame, chains: tuple[str, ...], support: int = 2, margin: int = 3) -> tuple[Table, ...]:
    """Tables of what stands for what in the twins that no learned chain explains.

    An entry needs ``support`` forms with a twin ``margin`` times as frequent. Entries join the
    first table in which neither side is taken, the best supported first, so each table is one
    to one. What comes to the driver is a count for each pair of characters: as many as the
    alphabets allow, not the texts.
    """
    rest = known.where((F.col("m") >= margin * F.col("n")) & (F.size("chains") == 0))
    counted = rest.select("form", F.explode("entries").alias("e")).groupBy("e.garbled", "e.clean").agg(F.count_distinct("form").alias("n")).where(F.col("n") >= support)
    tables: list[tuple[dict[str, str], set[str]]] = []
    for r in sorted(counted.collect(), key=lambda r: (-r["n"], r["garbled"], r["clean"])):
        for forward, taken in tables:
            if r["garbled"] not in forward and r["clean"] not in taken:
                break
        else:
            forward, taken = {}, set()
            tables.append((forward, taken))
        forward[r["garbled"]] = r["clean"]
        taken.add(r["clean"])
    return tuple(Table(forward) for forward, _ in tables)


def learned_chains(known: DataFrame, support: int = 2) -> tuple[str, ...]:
    """The fewest chains that explain the garbled forms, by greedy cover.

    A chain must explain ``support`` forms that those before it don't. What comes to the
    driver is a count for each set of chains that explain the same forms; the sets are few,
    as they depend on the fixed list of encodings alone, not on the texts.
    """
    sure = known.where(F.size("chains") > 0).where((F.col("m") > F.col("n")) | (F.size("chains") == 1))
    sets = [(set(r["chains"]), r["n"]) for r in sure.groupBy("chains").agg(F.count_distinct("form").alias("n")).collect()]
    chosen: list[str] = []
    while sets:
        weight: dict[str, int] = {}
        for chains, n in sets:
            for chain in chains:
                weight[chain] = weight.get(chain, 0) + n
        best = max(weight, key=lambda c: (weight[c], -ORDER[c]))
        if weight[best] < support:
            break
        chosen.append(best)
        sets = [(chains, n) for chains, n in sets if best not in chains]
    return tuple(chosen)


def _applied(chains: tuple[str | Table, ...], lost: bool, cells: bytes):
    """(doc_id, text) to (doc_id, found, restored, forms): whether a transformation shows, what it
    restores, and the words and sentences that a twin may explain, by the filter of their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(cells, np.uint8)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = SENTENCE.split(text)
                high = [p for p in parts[::2] if not p.isascii()]
                fixed, gain = repair_parts(parts, chains)
                found = bool(gain) or lost and LOST in text
                whole = gain and LOST not in fixed and not any(disorder(w) for w in WORD.findall(fixed) if HIGH.search(w))
                forms = [*{*high, *(w for p in high for w in WORD.findall(p) if not w.isascii())}]
                digests = np.fromiter(map(xxhash.xxh3_64_intdigest, forms), np.uint64, len(forms))
                near = [forms[i] for i in np.flatnonzero(in_filter(bits, digests))]
                if found or near:
                    rows.append((key, found, fixed if whole else None, near))
            types = (pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", "found", "restored", "forms"])

    return run


def garbled_documents(documents: DataFrame, support: int = 2, margin: int = 3) -> DataFrame:
    """(doc_id, restored) of the documents with a wrongly decoded passage.

    documents: doc_id, text. A document counts if undoing a learned transformation brings
    order into a sentence of it (restored is null if some disorder stays), if it holds a form
    that a learned chain explains from a twin ``margin`` times as frequent, or if characters
    were lost and twins show that the mark for them stands for others (then, and where only a
    twin shows the fault, restored is null). Null, empty and plain ASCII texts are no case.
    """
    found = forms(documents)
    known = settle(explained(twins(found, margin)))
    chains = learned_chains(known, support)
    tables = learned_tables(known, chains, support, margin)
    lost = LOSS in chains
    chains = tuple(c for c in chains if c != LOSS)
    texts = documents.where("text is not null and doc_id is not null").where(F.col("text").rlike(NON_ASCII)).select("doc_id", "text")
    certain = known.where((F.col("m") >= margin * F.col("n")) & F.arrays_overlap("chains", F.array(*map(F.lit, chains or ("none",))))).select("form", "key").distinct()
    applied = settle(texts.mapInArrow(_applied((*tables, *chains), lost, key_filter(certain)), "doc_id long, found boolean, restored string, forms array<string>"))
    by_twin = applied.select("doc_id", F.explode("forms").alias("form")).join(certain, "form", "left_semi").select("doc_id", F.lit(None).cast("string").alias("restored"))
    return applied.where("found").select("doc_id", "restored").unionByName(by_twin).groupBy("doc_id").agg(F.max("restored").alias("restored"))
