"""Claims in plain sentences: phrases of the vocabulary between a subject and its objects."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import norm_name
from attesta.sources.vocabulary import phrase_rows

#: Words, and the signs that end or part clauses; a full stop inside a name is part of it.
TOKEN = re.compile(r"\n|[,;!?]|\.+(?=\s|$)|[^\s,;!?]+?(?=\.*(?:[\s,;!?]|$))")
ENDS = frozenset("\n;!?")
#: Words that start a clause of their own after a comma; that don't belong to a name; that part objects; that stand for the last subject.
FRESH = frozenset("and but it the which".split())
FILLERS = frozenset("the a an our its their this that and but also then".split())
PARTING = frozenset([",", "and", "also"])
PRONOUNS = frozenset("it they this that which them".split())
# Words that deny a clause; "no" only does before "longer".
DENIALS = frozenset("not doesn't didn't never stopped removed dropped".split())
#: Phrases that name several predicates; which one is meant, an existing link between the two can tell.
AMBIGUOUS = ("uses", "handles")
SURE, DENIED, NOTED = 0.75, 0.8, 0.6

PHRASES: dict[str, list[tuple[tuple[str, ...], str]]] = {}
for _phrase, _predicate in phrase_rows():
    PHRASES.setdefault(_phrase.split()[0], []).append((tuple(_phrase.split()), _predicate))
for _ways in PHRASES.values():
    _ways.sort(key=lambda way: -len(way[0]))


def clauses(text: str) -> Iterator[list[str]]:
    """The words of each clause, commas between them included."""
    found = [m.group() for m in TOKEN.finditer(text)]
    clause: list[str] = []
    for i, token in enumerate(found):
        after = found[i + 1].lower() if i + 1 < len(found) else ""
        if token in ENDS or token.startswith(".") and not token.strip(".") or token == "," and after in FRESH:
            if clause:
                yield clause
            clause = []
        else:
            clause.append(token)
    if clause:
        yield clause


def marked(words: list[str]) -> list[tuple[int, int, str, str]]:
    """(start, end, phrase, predicate) of the phrases in a clause: the earliest, and there the longest, that something follows."""
    found, i = [], 0
    while i < len(words):
        for phrase, predicate in PHRASES.get(words[i], ()):
            if tuple(words[i : i + len(phrase)]) == phrase and i + len(phrase) < len(words):
                found.append((i, i + len(phrase), " ".join(phrase), predicate))
                i += len(phrase) - 1
                break
        i += 1
    return found


def denials(words: list[str]) -> set[int]:
    """Places of the words that deny a clause."""
    found = {i for i, w in enumerate(words) if w in DENIALS}
    for i, pair in enumerate(zip(words, words[1:])):
        if pair in (("no", "longer"), ("does", "not")):
            found |= {i, i + 1}
    return found


def name(tokens: list[str], lower: list[str]) -> str:
    """What the tokens name: without words before it that belong to no name, and signs after it."""
    begin = 0
    while begin < len(tokens) - 1 and lower[begin] in FILLERS:
        begin += 1
    return " ".join(t for t in tokens[begin:] if t != ",").rstrip(".,;:")


def parse(text: str, subject: str | None = None) -> tuple[list[tuple[str, str, str, bool, float, str]], list[str]]:
    """(subject, predicate, object, polarity, confidence, phrase) of each statement in ``text``, and the clauses that make none.

    A clause's phrases cut it into a subject and the objects after each phrase. "It" and an
    empty subject stand for the last one named. A denial anywhere in the clause turns it
    round. Without a phrase, "X is a Y" is a note.
    """
    found: list[tuple[str, str, str, bool, float, str]] = []
    rest: list[str] = []
    for tokens in clauses(text):
        lower = [t.lower() for t in tokens]
        before = len(found)
        marks, denied = marked(lower), denials(lower)
        if not marks:
            at = next((i for i in range(1, len(lower) - 2) if lower[i] == "is" and lower[i + 1] in ("a", "an", "the")), None)
            if at is not None and (name(tokens[:at], lower[:at]) or subject):
                subject = name(tokens[:at], lower[:at]) or subject
                found.append((subject, "note", name(tokens[at + 2 :], lower[at + 2 :]), True, NOTED, "is"))
        else:
            head = marks[0][0]
            while head and (head - 1 in denied or lower[head - 1] == "no"):
                head -= 1
            named = name(tokens[:head], lower[:head])
            if named and named.lower() not in PRONOUNS:
                subject = named
            for k, (_, begin, phrase, predicate) in enumerate(marks if subject else ()):
                end = marks[k + 1][0] if k + 1 < len(marks) else len(tokens)
                things: list[list[int]] = [[]]
                for i in range(begin, end):
                    if lower[i] in PARTING:
                        things.append([])
                    elif i not in denied and not (i == end - 1 and lower[i] in ("then", "it")):
                        things[-1].append(i)
                for thing in things:
                    said = name([tokens[i] for i in thing], [lower[i] for i in thing])
                    if said and said.lower() not in PRONOUNS:
                        found.append((subject, predicate, said, not denied, DENIED if denied else SURE, phrase))
        if len(found) == before and len(" ".join(tokens)) > 2:
            rest.append(" ".join(tokens))
    return found, rest


KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.float64(), pa.string())
NAMES = ["id", "subject", "predicate", "object", "polarity", "confidence", "phrase"]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *claim) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for claim in parse(text)[0]]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], NAMES)


def _unparsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, clause) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for clause in parse(text)[1]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["id", "clause"])


def _texts(texts: DataFrame) -> DataFrame:
    return texts.where("id is not null and text is not null").select("id", "text")


def statements(texts: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, polarity, confidence, phrase) of the claims in texts (id, text); null texts make none."""
    return _texts(texts).mapInArrow(_parsed, "id long, subject string, predicate string, object string, polarity boolean, confidence double, phrase string")


def unparsed(texts: DataFrame) -> DataFrame:
    """(id, clause) of the clauses from which no claim could be made."""
    return _texts(texts).mapInArrow(_unparsed, "id long, clause string")


def by_existing(said: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``said`` with the predicate of an ambiguous phrase taken from the link that is there between its ends, if there is one.

    entities: id, display_name; edges: subject, predicate, object. Of several links the first
    by name counts. Names are looked up in their normal form.
    """
    named = entities.select("id", norm_name(F.col("display_name")).alias("key")).where("key <> ''")
    linked = (
        edges.join(named.withColumnsRenamed({"id": "subject", "key": "s"}), "subject").join(named.withColumnsRenamed({"id": "object", "key": "o"}), "object")
        .groupBy("s", "o").agg(F.min("predicate").alias("known"))
    )
    keyed = said.withColumn("s", norm_name(F.col("subject"))).withColumn("o", norm_name(F.col("object")))
    meant = F.when(F.col("phrase").isin(*AMBIGUOUS), F.col("known"))
    return keyed.join(linked, ["s", "o"], "left").withColumn("predicate", F.coalesce(meant, "predicate")).select(*said.columns)
