"""Variant spellings of names: noisy-channel attribution to the entities that they name.

Spellings are counted and ranked by frequency. The catalogue's names are the first candidate
forms; how often each is mentioned as it stands is its prior. Every other spelling meets the
forms that share their core (a person's surname, a title's first word) up to two edits, found
by an equi-join on strings with letters left out. The channel's operations (typos,
abbreviations, nicknames, initials, dropped, moved and joined parts) are counted for each
pair; their likelihoods are estimated from the mentions themselves, starting from a prior of
fixed weight. A part that a form doesn't explain rules it out, so names of somebody similar
stay unattached. Each spelling goes to its maximum posterior. Frequent spellings that were
attached are candidate forms in a second round for those that weren't.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.filters import in_filter, key_filter
from attesta.session import settle, spread

NAMED = ("person", "team", "system")
#: Cores of more letters are looked up by thirds, as leaving letters out makes too many strings.
LONG = 40
#: Cores of more names than this are met with a second key beside the core.
HEAVY = 32

# Short forms of given names.
NICKNAMES = {
    "abigail": "abby gail abbie", "alexander": "alec alex sasha sandy xander", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benjamin": "ben benny benji",
    "charles": "charlie chuck chas", "christopher": "chris kit topher", "christine": "chris tina chrissy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debs", "edward": "ed eddie ned ted teddy",
    "elizabeth": "beth betty liz lizzie eliza betsy libby", "frances": "fran frankie fanny", "francis": "frank frankie", "gabriel": "gabe", "george": "georgie", "gregory": "greg", "henry": "hank harry hal", "isabella": "bella izzy isa",
    "james": "jim jamie jimmy", "jennifer": "jen jenny", "john": "jack johnny", "jonathan": "jon jonny", "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy kit katie kay", "kenneth": "ken kenny", "lawrence": "larry laurie",
    "leonard": "len lenny leo", "margaret": "maggie peggy meg marge", "matthew": "matt matty", "michael": "mick mike mikey", "nicholas": "nick nicky", "oliver": "ollie", "patricia": "pat patty trish", "patrick": "pat paddy",
    "peter": "pete", "philippa": "pippa pip", "philip": "phil pip", "rebecca": "becky becca", "richard": "dick rick rich", "robert": "bob bobby rob robbie bert", "ronald": "ron ronnie", "samuel": "sam sammy", "stephen": "steve", "susan": "sue susie suzy",
    "theodore": "ted theo teddy", "thomas": "tom tommy", "timothy": "tim", "veronica": "ronnie vera", "victoria": "tori vicky vic", "wilhelmina": "mina willa billie minnie", "william": "bill billy will willy", "zachary": "zach zack zac",
}
FULL: dict[str, list[str]] = {}
for _full, _line in NICKNAMES.items():
    for _short in _line.split():
        FULL.setdefault(_short, []).append(_full)
# Words beside a name, words that tell namesakes apart, particles and suffixes of surnames.
BESIDE = frozenset("the our crew folks people guys gang lot lead on call oncall dr mr mrs ms prof".split())
REGIONS = frozenset("us eu uk apac emea na latam amer anz asia global north south east west central northeast northwest southeast southwest".split())
PARTICLES = frozenset("de del della der den di da do dos das du la le los las van von zu zum zur ten ter bin ibn al el st mac mc".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
PLAIN = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ŧ": "t", "ħ": "h"})

#: Operations of the channel and minus their log-likelihoods before any mention is seen. Counts of
#: all of them are packed into one number, OP_BITS bits each, so that they add up by adding it.
OPERATIONS = {"typo": 2.0, "start": 0.5, "letters": 0.9, "nickname": 0.7, "initial": 1.5, "short": 1.0, "extra": 0.5, "dropped": 1.0, "moved": 0.3, "joined": 0.3}
OP_BITS = 6
TYPO, START, LETTERS, NICKNAME, INITIAL, SHORT, EXTRA, DROPPED, MOVED, JOINED = (1 << OP_BITS * k for k in range(len(OPERATIONS)))
COST = dict(zip((TYPO, START, LETTERS, NICKNAME, INITIAL, SHORT, EXTRA, DROPPED, MOVED, JOINED), OPERATIONS.values()))
#: Cost beyond which a spelling is more likely the name of somebody unknown.
UNKNOWN = 9.0
Reading = tuple[float, int]


def op(unit: int, n: int = 1) -> Reading:
    return n * COST[unit], n * unit


def both(*readings: Reading) -> Reading:
    return sum(r[0] for r in readings), sum(r[1] for r in readings)


FREE: Reading = (0.0, 0)


def unaccented(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def squash(text: str) -> str:
    """Letters and digits in lower case; spellings that agree in this are no variants."""
    return "".join(c for c in text.lower() if c.isalnum())


WORDS = re.compile(r"v\d{1,3}(?![^\W_])|[^\W\d_]+?(?=v?\d{1,3}(?![^\W_]))|[^\W\d_]+|\d+")


def tokens(text: str) -> list[str]:
    """Words in lower case without accents; a capital after small letters and a number start one."""
    plain = text if text.isascii() else unaccented(text)
    parted = re.sub(r"(?<=[a-z][a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[A-Z][a-z]{2})", " ", plain)
    return WORDS.findall(parted.lower().translate(PLAIN))


def is_mark(token: str) -> bool:
    """Whether a token tells namesakes apart: a region, number or version."""
    return token in REGIONS or bool(re.fullmatch(r"v?\d{1,3}", token))


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; ``most`` + 1 where it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    if not most:
        return 1
    lo, hi = 0, 0  # equal ends cost nothing; one place is kept on either side for swaps
    shorter = min(len(a), len(b))
    while lo < shorter and a[lo] == b[lo]:
        lo += 1
    while hi < shorter - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i, c in enumerate(a, 1):  # only cells within ``most`` of the diagonal
        now = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = row.get(j, far) + 1
            if j:
                best = min(best, now.get(j - 1, far) + 1, row.get(j - 1, far) + (c != b[j - 1]))
                if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == b[j - 1]:
                    best = min(best, before.get(j - 2, far) + 1)
            now[j] = best
        if min(now.values()) > most:
            return far
        before, row = row, now
    return min(row.get(len(b), far), far)


def allowed(length: int) -> int:
    """Typos that a word may have."""
    return 2 if length >= 8 else 1 if length >= 5 else 0


def core_typos(length: int) -> int:
    """Typos that a core may have; other parts must fit beside it, so four letters may have one."""
    return 2 if length >= 8 else 1 if length >= 4 else 0


def abbreviates(short: str, full: str) -> bool:
    """Whether letters of ``full`` were left out: a start of it, or its first letter (or an x for
    "ex") and others in their order, without being nearly the whole word."""
    if not 2 <= len(short) < len(full) or len(full) < 4:
        return False
    if full.startswith(short):
        return True
    if short[0] != full[0] and not (short[0] == "x" and full[:2] == "ex"):
        return False
    rest = iter(full)
    return all(c in rest for c in short) and len(short) <= max(2, len(full) - 2)


def word_reading(token: str, word: str) -> Reading | None:
    """How somebody may have written ``token`` for ``word``; null if nobody would."""
    if token == word:
        return FREE
    most = allowed(min(len(token), len(word)))
    d = edits(token, word, most)
    if abbreviates(token, word) and not (len(token) >= 5 and d == 1 and not word.startswith(token)):
        return op(START if word.startswith(token) else LETTERS)
    if d <= most:
        return op(TYPO, d)
    if len(token) >= 5 and any(edits(token, word[:n], 1) <= 1 for n in range(len(token) - 1, len(token) + 2) if n < len(word)):
        return both(op(START), op(TYPO))
    if len(word) <= 6 and abbreviates(word, token):  # the catalogue's own word is the short one
        return op(LETTERS)
    return None


def given_typos(length: int) -> int:
    return 2 if length >= 6 else 1


def given_reading(token: str, given: str) -> Reading | None:
    if token == given:
        return FREE
    if given in FULL.get(token, ()) or token in FULL.get(given, ()):
        return op(NICKNAME)
    if len(token) == 1:
        return op(INITIAL) if token == given[0] else None
    if len(given) == 1:
        return op(INITIAL) if given == token[0] else None
    if token in FULL or token in NICKNAMES:
        return None  # somebody else's name
    d = edits(token, given, given_typos(len(given)))
    if d <= given_typos(len(given)):
        return op(TYPO, d)
    return op(SHORT) if len(token) >= 3 and given.startswith(token) else None


def person_reading(parts: list[str], core: str, given: list[str], others: list[str]) -> Reading | None:
    """The cheapest reading of ``parts`` as a person's name.

    There must be the core, a given name (or nickname, initial, start) if the person has one,
    and every other part must be another given name, part of the surname, a suffix, or one
    initial that isn't on record.
    """
    best: Reading | None = None
    most = core_typos(len(core))

    def rest_of(left: list[str], names: list[str], surname: list[str], spare: int) -> Reading | None:
        if not left:
            return FREE
        token, after, found = left[0], left[1:], None
        options = [(r, [*names[:k], *names[k + 1 :]], surname, spare) for k, n in enumerate(names) if (r := given_reading(token, n))]
        options += [(op(TYPO, d), names, [*surname[:k], *surname[k + 1 :]], spare) for k, n in enumerate(surname) if (d := edits(token, n, allowed(len(n)))) <= allowed(len(n))]
        if token in SUFFIXES:
            options.append((FREE, names, surname, spare))
        if len(token) == 1 and spare:
            options.append((op(EXTRA), names, surname, spare - 1))
        for r, n, s, k in options:
            more = rest_of(after, n, s, k)
            if more is not None and (found is None or r[0] + more[0] < found[0]):
                found = both(r, more)
        return found

    def better(reading: Reading) -> None:
        nonlocal best
        if best is None or reading[0] < best[0]:
            best = reading

    if len(parts) > len(given) + len(others) + 4:
        return None
    for i, part in enumerate(parts):
        d = edits(part, core, most)
        if d > most:
            continue
        rest = parts[:i] + parts[i + 1 :]
        if not given:
            more = rest_of(rest, [], others, 1)
            if more is not None:
                better(both(op(TYPO, d), more))
        for j, token in enumerate(rest):
            for k, name in enumerate(given):
                first = given_reading(token, name)
                if first is not None:
                    more = rest_of(rest[:j] + rest[j + 1 :], given[:k] + given[k + 1 :], others, 1)
                    if more is not None:
                        better(both(op(TYPO, d), first, more))
    if len(parts) == 1 and given:  # an initial or a given name and the surname in one
        whole = parts[0]
        for lead, way in ((given[0][0], op(INITIAL)), (given[0], op(JOINED)), *((n, op(NICKNAME)) for n in NICKNAMES.get(given[0], "").split())):
            for stem, moved in ((whole[len(lead) :] if whole.startswith(lead) else "", FREE), (whole[: -len(lead)] if whole.endswith(lead) else "", op(MOVED))):
                if stem and (d := edits(stem, core, most)) <= most:
                    better(both(op(TYPO, d), way, moved))
    return best


def segment(rest: str, words: tuple[str, ...]) -> tuple[Reading, tuple[str, ...]] | None:
    """The cheapest way to read ``rest`` as some of ``words`` written together, and those words."""
    if not rest:
        return FREE, ()
    best = None
    for i, word in enumerate(words):
        for n in range(min(len(rest), len(word) + 1), 0, -1):
            piece = rest[:n]
            reading = (FREE if piece == word else None) if is_mark(word) else word_reading(piece, word)
            if reading is None or len(piece) < 2 and piece != word:
                continue
            after = segment(rest[n:], words[:i] + words[i + 1 :])
            if after is not None and (best is None or reading[0] + after[0][0] < best[0][0]):
                best = both(reading, after[0]), (word, *after[1])
    return best


def without(words: list[str], gone: tuple[str, ...]) -> list[str]:
    left = list(words)
    for w in gone:
        if w in left:
            left.remove(w)
    return left


def title_reading(parts: list[str], core: str, words: list[str]) -> Reading | None:
    """The cheapest reading as a team's or system's name: its core, marks exactly, no word that it hasn't."""
    marks = sorted(w for w in words if is_mark(w))
    plain = [w for w in words if not is_mark(w)]
    best = None
    limit = core_typos(len(core))
    for i, part in enumerate(parts):
        heads = [(edits(part, core, limit), "")]
        if len(part) > len(core) + 2 and heads[0][0] > limit:
            heads = [(edits(part[:n], core, limit), part[n:]) for n in range(max(2, len(core) - limit), min(len(part), len(core) + limit) + 1)]
        for d, tail in heads:
            if d > limit:
                continue
            left, reading, seen = list(plain), op(TYPO, d), []
            if tail:
                read = segment(tail, tuple(words))
                if read is None:
                    continue
                reading = both(reading, read[0], op(JOINED))
                seen = [w for w in read[1] if is_mark(w)]
                left = without(left, read[1])
            for token in parts[:i] + parts[i + 1 :]:
                if is_mark(token):
                    seen.append(token)
                    continue
                options = [(r, w) for w in left if (r := word_reading(token, w)) is not None]
                if options:
                    r, w = min(options)
                    reading = both(reading, r)
                    left.remove(w)
                    continue
                free = [m for m in marks if marks.count(m) > seen.count(m)]
                joined = segment(token, tuple(left + free)) if len(token) >= 3 else None
                if joined is None:
                    break
                reading = both(reading, joined[0], op(JOINED))
                seen += [w for w in joined[1] if is_mark(w)]
                left = without(left, joined[1])
            else:
                if sorted(seen) == marks and not (plain and len(left) == len(plain)):
                    reading = both(reading, op(DROPPED, len(left)), op(MOVED) if i else FREE)
                    best = reading if best is None or reading[0] < best[0] else best
    return best


def parse_person(name: str) -> list[tuple[str, list[str], list[str]]]:
    """(core, given names, other surname parts) of each way to take a person's surname.

    The surname is what precedes a comma, else the last word with the particles before it;
    of several parts each may be the core, as may all of them written together.
    """
    if "," in name:
        before, _, after = name.partition(",")
        surname, given = tokens(before), [t for t in tokens(after) if t not in SUFFIXES]
    else:
        chunks = [t for t in map(tokens, name.split()) if t]
        if len(chunks) > 1 and all(t in SUFFIXES for t in chunks[-1]):
            chunks.pop()
        if len(chunks) == 1:
            chunks = [[t] for t in chunks[0]]
        at = len(chunks) - 1
        while at > 1 and chunks[at - 1][-1] in PARTICLES:
            at -= 1
        surname, given = [t for c in chunks[at:] for t in c], [t for c in chunks[:at] for t in c]
    if not surname:
        return []
    ways = [(s, given, surname[:k] + surname[k + 1 :]) for k, s in enumerate(surname) if s not in PARTICLES or len(surname) == 1]
    if len(surname) > 1:
        ways.append(("".join(surname), given, []))
    return ways


def parse_mention(raw: str) -> list[str]:
    parts = tokens(raw)
    kept = [p for p in parts if p not in BESIDE]
    return kept or parts


MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
POWERS = np.array([pow(BASE, k, 1 << 64) for k in range(LONG + 4)], np.uint64)
BACK, BACK_TWO = (np.uint64(pow(pow(BASE, -1, 1 << 64), k, 1 << 64)) for k in (1, 2))


def deletion_keys(texts: list[str], most: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, 64-bit key) of each text and of what is left of it when up to
    ``most`` of its characters are left out; texts of up to LONG + 3 characters.

    The key of a string is a polynomial of its characters, so those of all shortened strings
    follow from running sums. Two strings under one key only make one candidate more.
    """
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (t, d) in enumerate(zip(texts, most)):
        shapes.setdefault((len(t), min(d, len(t))), []).append(i)
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for (n, d), members in shapes.items():
        for begin in range(0, len(members), 4096):
            part = members[begin : begin + 4096]
            codes = np.frombuffer("".join(texts[i] for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), n).astype(np.uint64)
            upto = np.zeros((len(part), n + 1), np.uint64)
            np.cumsum(codes * POWERS[:n], axis=1, out=upto[:, 1:])
            whole = upto[:, n:]
            found = [whole]
            if d >= 1:
                found.append(upto[:, :n] + (whole - upto[:, 1:]) * BACK)
            if d >= 2:
                i, j = np.triu_indices(n, 1)
                found.append(upto[:, i] + (upto[:, j] - upto[:, i + 1]) * BACK + (whole - upto[:, j + 1]) * BACK_TWO)
            table = np.concatenate(found, axis=1)
            keys.append(table.ravel())
            owners.append(np.repeat(np.array(part, np.int64), table.shape[1]))
    key = np.concatenate(keys)
    key ^= key >> np.uint64(31)
    return np.concatenate(owners), key * MIX


def third_keys(texts: list[str], shifted: bool) -> tuple[np.ndarray, np.ndarray]:
    """The same for longer texts: their thirds with length and place. Two edits leave one third
    as it is, moved by two places at most; ``shifted`` gives those of all texts within two edits."""
    owners, keys = [], []
    for i, t in enumerate(texts):
        found = set()
        for n in range(max(LONG + 1, len(t) - 2), len(t) + 3) if shifted else (len(t),):
            third = n // 3
            found |= {f"{n}:{k}:{t[k * third + m : (k + 1) * third + m]}" for k in range(3) for m in (range(-2, 3) if shifted else (0,)) if k * third + m >= 0}
        keys += map(xxhash.xxh3_64_intdigest, found)
        owners += [i] * len(found)
    return np.array(owners, np.int64), np.array(keys, np.uint64)


def core_keys(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    short = [i for i, c in enumerate(cores) if len(c) <= LONG]
    long = [i for i, c in enumerate(cores) if len(c) > LONG]
    a, b = deletion_keys([cores[i] for i in short], [core_typos(len(cores[i])) for i in short])
    c, d = third_keys([cores[i] for i in long], False)
    return np.concatenate([np.array(short, np.int64)[a], np.array(long, np.int64)[c]]), np.concatenate([b, d])


def part_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys that a part of a mention shares with ``core_keys`` of any core within its typos."""
    short = [i for i, t in enumerate(texts) if len(t) <= LONG + 2]
    long = [i for i, t in enumerate(texts) if len(t) > LONG - 2]
    a, b = deletion_keys([texts[i] for i in short], [2 if len(texts[i]) >= 6 else 1 if len(texts[i]) >= 3 else 0 for i in short])
    c, d = third_keys([texts[i] for i in long], True)
    return np.concatenate([np.array(short, np.int64)[a], np.array(long, np.int64)[c]]), np.concatenate([b, d])


def core_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        owner, key = core_keys(batch.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(key.view(np.int64))], ["core", "key"])


def inner(part: str, alone: bool, longest: int) -> set[str]:
    """``part`` and the strings inside it that may be a core written together with other things.

    None is longer than the longest core and two typos, as others can't be one; a core of
    more than LONG letters is only found as a part of its own.
    """
    out = {part} if len(part) <= longest + 2 else set()
    if alone or len(part) >= 14:
        for n in range(2 if alone else 7, min(len(part) - 1, longest + 2, LONG) + 1):
            out.add(part[:n])
            if alone:
                out.add(part[-n:])
    return out


def form_rows(cells: bytes, longest: int):
    """(raw, kind, n) to one row a form: its parts, squashed form, and the keys that some core may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(cells, np.uint8)
        for batch in batches:
            parsed = [parse_mention(r) for r in batch.column(0).to_pylist()]
            texts, owners = [], []
            for i, parts in enumerate(parsed):
                found = set().union(*(inner(p, len(parts) == 1, longest) for p in parts if not is_mark(p)))
                texts += found
                owners += [i] * len(found)
            number, key = part_keys(texts)
            kept = in_filter(bits, key)
            row, key = np.array(owners, np.int64)[number[kept]], key[kept]
            order = np.argsort(row, kind="stable")
            offsets = np.searchsorted(row[order], np.arange(len(parsed) + 1))
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key[order].view(np.int64)))
            shape = pa.array([parts or None for parts in parsed], pa.list_(pa.string()))
            squashed = pa.array([squash(r) for r in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], shape, squashed, keys], ["raw", "kind", "n", "parts", "squashed", "keys"])

    return run


NAME_SCHEMA = "entity_id string, kind string, core string, words array<string>, others array<string>, squashed string"


def entity_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kind, name) to the ways to read each name."""
    for batch in batches:
        rows = []
        for key, kind, name in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if kind == "person":
                ways = parse_person(name)
            else:
                words = tokens(name)
                ways = [(words[0], words[1:], [])] if words else []
            rows += [(key, kind, core, words, others, squash(name)) for core, words, others in ways]
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["entity_id", "kind", "core", "words", "others", "squashed"])


def _fuller(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (kind, word, full, n) those in which ``word`` abbreviates ``full``, with whether it is its start."""
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(4)]
        rows = [(k, w, f, f.startswith(w), n) for k, w, f, n in zip(*columns) if abbreviates(w, f)]
        types = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["kind", "word", "full", "starts", "n"])


def written_out(parsed: DataFrame) -> DataFrame:
    """``parsed`` with abbreviated words of titles written out as what they most likely stand for.

    Of the kind's more frequent words one that starts so comes before one with these letters,
    then the most frequent. Words meet by their first letter and a later one.
    """
    titles = parsed.where("kind <> 'person'")
    counted = titles.select("kind", F.explode("words").alias("word")).groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
    plain = counted.where(~F.col("word").rlike(r"^v?\d{1,3}$") & ~F.col("word").isin(*sorted(REGIONS)))
    short = plain.where(F.length("word").between(2, 6)).select("kind", "word", F.col("n").alias("own"), F.substring("word", 1, 2).alias("key"))
    later = F.array_distinct(F.split(F.substring("word", 2, 1 << 20), ""))
    heads = F.when(F.col("word").startswith("ex"), F.array(F.lit("e"), F.lit("x"))).otherwise(F.array(F.substring("word", 1, 1)))
    full = plain.where("n >= 2 and length(word) >= 4").select("kind", F.col("word").alias("full"), "n", F.explode(heads).alias("head"), later.alias("later")).select("kind", "full", "n", "head", F.explode("later").alias("next"))
    pairs = short.join(full.select("kind", "full", "n", F.concat("head", "next").alias("key")), ["kind", "key"]).where("n > own and word <> full").select("kind", "word", "full", "n").distinct()
    best = (
        pairs.mapInArrow(_fuller, "kind string, word string, full string, starts boolean, n long").groupBy("kind", "word")
        .agg(F.min(F.struct(~F.col("starts"), -F.col("n"), F.col("full").alias("full")))["full"].alias("full"))
    )
    placed = titles.select("entity_id", "kind", F.posexplode("words").alias("at", "word")).join(best, ["kind", "word"], "left")
    whole = placed.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("full", "word").alias("w")))), lambda x: x["w"]).alias("longer"))
    return parsed.join(whole, "entity_id", "left").withColumn("words", F.when(F.col("kind") == "person", F.col("words")).otherwise(F.coalesce("longer", "words"))).drop("longer")


def second_keys(word: str) -> set[str]:
    """Keys of a form's word; each token that ``word_reading`` or ``given_reading`` takes for it has one of them."""
    heads = {word[0], "x"} if word.startswith("ex") else {word[0]}
    out = {f"a{h}{c}" for h in heads for c in word[1:]} | {f"i{word[0]}"}
    out |= {f"b{word[2:4]}"} if len(word) >= 4 else {f"d{word[:k]}{word[k + 1:]}" for k in range(len(word))} | {f"d{word}"}
    if len(word) >= 6:
        out.add(f"c{word[4:6]}")
    if len(word) <= 6:
        out.add(f"r{word[:2]}")
    return out


def token_keys(token: str) -> set[str]:
    out = {f"a{token[k : k + 2]}" for k in ((0,) if len(token) < 7 else range(len(token) - 1))} | {f"i{token[0]}", f"i{token[-1]}"}
    out |= {f"b{token[k : k + 2]}" for k in range(min(5, len(token) - 1))} | {f"c{token[k : k + 2]}" for k in range(2, min(7, len(token) - 1))}
    if len(token) <= 4:
        out |= {f"d{token[:k]}{token[k + 1:]}" for k in range(len(token))} | {f"d{token}"}
    for name in FULL.get(token, ()):
        out.add(f"a{name[:2]}")
    for name in NICKNAMES.get(token, "").split():
        out.add(f"a{name[:2]}")
    return out | {f"r{token[0]}{c}" for c in token[1:]}


def _seconds(of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {"n"}.union(*(of(w) for w in words if not is_mark(w)))
                ids += [key] * len(found)
                keys += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], ["id", "second"])

    return run


def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of forms and names to the operations of those that can be."""
    for batch in batches:
        rows = []
        column = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for form, name, parts, kind, core, words, others in zip(*(column[n] for n in ("form", "name", "parts", "ekind", "core", "words", "others"))):
            reading = person_reading(parts, core, words, others) if kind == "person" else title_reading(parts, core, words)
            if reading is not None and reading[0] <= UNKNOWN:
                rows.append((form, name, reading[0], reading[1]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["form", "name", "cost", "ops"])


def classes(known: DataFrame) -> DataFrame:
    """One row for each different name: entities that share it can't be told apart by spelling.

    The entity with the largest prior stands for it; ``tied`` says that another has the same.
    """
    alike = known.groupBy("kind", "core", "words", "others", "prior").agg(F.min("entity_id").alias("entity_id"), F.max("entity_id").alias("last"))
    top = alike.groupBy("kind", "core", "words", "others").agg(F.max(F.struct("prior", "entity_id", "last")).alias("t"))
    return top.select(
        F.xxhash64("kind", "core", "words", "others").alias("name"), F.col("kind").alias("ekind"), "core", "words", "others",
        "t.entity_id", (F.col("t.entity_id") != F.col("t.last")).alias("tied"), "t.prior",
    )


def scored(met: DataFrame, forms: DataFrame, names: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(form, n, entity_id, tied, prior, cost, ops) of forms and the names that they may stand for.

    met: form, core. A core of up to ``heavy`` names meets them all; one of more takes only
    those with which a form shares a second key, which loses no pair that has a reading.
    """
    size = names.groupBy("core").agg((F.count(F.lit(1)) > heavy).alias("hot"))
    paired = met.join(size, "core")
    rare = paired.where("not hot").join(names.select("core", "name"), "core").select("form", "name")
    hot_names = names.join(size.where("hot"), "core").select(F.col("name").alias("id"), "words", "core")
    hot_keys = hot_names.select("id", "words").mapInArrow(_seconds(second_keys), "id long, second string").join(hot_names.select("id", "core"), "id")
    hot_met = paired.where("hot").select("form", "core")
    hot_forms = forms.join(hot_met.select("form").distinct(), "form", "left_semi").select(F.col("form").alias("id"), "parts").mapInArrow(_seconds(token_keys), "id long, second string")
    hot = hot_forms.join(hot_met, F.col("id") == F.col("form")).select("form", "core", "second").join(hot_keys.withColumnRenamed("id", "name"), ["core", "second"]).select("form", "name")
    pairs = (
        rare.union(hot).distinct()
        .join(names.select("name", "ekind", "core", "words", "others"), "name")
        .join(forms.select("form", "kind", "parts"), "form")
        .where(F.col("kind").isNull() | (F.col("kind") == F.col("ekind")))
        .select("form", "name", "parts", "ekind", "core", "words", "others")
    )
    read = spread(pairs).mapInArrow(score, "form long, name long, cost double, ops long")
    return read.join(names.select("name", "entity_id", "tied", "prior"), "name").join(forms.select("form", "n"), "form").select("form", "n", "entity_id", "tied", "prior", "cost", "ops", "name")


def count_of(k: int) -> Column:
    return F.shiftright("ops", OP_BITS * k).bitwiseAND(F.lit((1 << OP_BITS) - 1))


def winners(found: DataFrame, cost: Column) -> DataFrame:
    """(form, n, entity_id, posterior, name, ops) of each form's maximum posterior; none where two entities share it."""
    posterior = F.round(F.log1p(F.col("prior").cast("double")) - cost, 9)
    rated = found.withColumn("posterior", posterior)
    best = rated.groupBy("form", "n").agg(
        F.min(F.struct(-F.col("posterior"), "entity_id", "tied", "name", "ops")).alias("a"), F.max(F.struct("posterior", "entity_id", "tied")).alias("z")
    )
    return best.where(F.col("a.entity_id").eqNullSafe(F.col("z.entity_id")) & ~F.col("a.tied") & ~F.col("z.tied")).select("form", "n", F.col("a.entity_id").alias("entity_id"), F.col("z.posterior").alias("posterior"), "a.name", "a.ops")


def likelihoods(found: DataFrame, weight: float = 100.0) -> list[float]:
    """Minus the log-likelihood of each operation, from the forms that the first costs attach.

    The first costs count as ``weight`` forms, so few mentions change little. What comes to
    the driver is one row.
    """
    sure = winners(found, F.col("cost"))
    row = sure.agg(F.count(F.lit(1)), *(F.sum(count_of(k)) for k in range(len(OPERATIONS)))).first()
    return [-math.log(min(1.0, ((row[k + 1] or 0) + weight * math.exp(-c)) / (row[0] + weight))) for k, c in enumerate(OPERATIONS.values())]


def _as_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Attached forms as names: the parts beside the one that is the core."""
    for batch in batches:
        rows = []
        for entity, kind, core, others, parts, n in zip(*(batch.column(k).to_pylist() for k in range(6))):
            near = [(edits(p, core, core_typos(len(core))), i) for i, p in enumerate(parts)]
            d, i = min(near, default=(9, 0))
            if d <= core_typos(len(core)):
                rows.append((entity, kind, core, [p for k, p in enumerate(parts) if k != i and p not in others], others, n))
        types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["entity_id", "kind", "core", "words", "others", "prior"])


def attributed(mention: DataFrame, entity: DataFrame, frequent: int = 5, heavy: int = HEAVY) -> DataFrame:
    """(mention_id, entity_id, posterior) of mentions that name an entity in another spelling.

    mention: mention_id, raw, kind; entity: id, kind, display_name; one row per id each. Null,
    empty and unknown names stay out, as do names that equal an entity's up to case, space
    and punctuation, and those whose maximum posterior two entities share. Equal spellings
    are worked on once, however often they occur. An attached spelling of ``frequent``
    mentions or more is a candidate form for those that no catalogue name explains.
    """
    named = entity.where(F.col("kind").isin(*NAMED) & F.col("display_name").isNotNull() & F.col("id").isNotNull()).select("id", "kind", "display_name")
    parsed = settle(named.mapInArrow(entity_rows, NAME_SCHEMA))
    longest = parsed.agg(F.coalesce(F.max(F.length("core")), F.lit(0))).first()[0]
    vocabulary = settle(parsed.select("core").distinct().transform(spread).mapInArrow(core_rows, "core string, key long"))

    kept = mention.where((F.col("kind").isNull() | F.col("kind").isin(*NAMED)) & (F.col("raw") != "")).select("mention_id", "raw", "kind")
    counted = kept.groupBy("raw", "kind").agg(F.count(F.lit(1)).alias("n"))
    shaped = spread(counted).mapInArrow(form_rows(key_filter(vocabulary), longest), "raw string, kind string, n long, parts array<string>, squashed string, keys array<long>")
    spellings = settle(shaped)
    # A form goes by a 64-bit digest; should two share one, each also meets the other's candidates, and nothing is lost.
    forms = settle(
        spellings.where("parts is not null and size(keys) > 0").join(parsed.select("squashed").distinct(), "squashed", "left_anti")
        .select(F.xxhash64("raw", "kind").alias("form"), "raw", "kind", "n", "parts", "keys")
    )
    spelt = spellings.groupBy("squashed").agg(F.sum("n").alias("prior"))
    known = written_out(parsed).join(spelt, "squashed", "left").withColumn("prior", F.coalesce("prior", F.lit(0)))
    names = settle(classes(known))

    met = settle(forms.select("form", F.explode("keys").alias("key")).join(vocabulary, "key").select("form", "core").distinct())
    found = settle(scored(met, forms, names, heavy))
    learned = likelihoods(found)
    cost = sum((count_of(k) * F.lit(c) for k, c in enumerate(learned)), F.lit(0.0))
    first = settle(winners(found, cost))

    again = (
        first.where(F.col("n") >= frequent).join(names.select("name", "ekind", "core", "others"), "name").join(forms.select("form", "parts"), "form")
        .select("entity_id", "ekind", "core", "others", "parts", "n").mapInArrow(_as_names, "entity_id string, kind string, core string, words array<string>, others array<string>, prior long")
    )
    left = met.join(found.select("form").distinct(), "form", "left_anti")
    second = winners(scored(left, forms, classes(again), heavy), cost)

    best = first.select("form", "entity_id", "posterior").union(second.select("form", "entity_id", "posterior")).join(forms.select("form", F.col("raw").alias("r"), F.col("kind").alias("k")), "form")
    return kept.join(best, (F.col("raw") == F.col("r")) & F.col("kind").eqNullSafe(F.col("k"))).select("mention_id", "entity_id", "posterior")
