"""What source files say about each other: imports, exports, components used, and the facts these join to."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fences around quoted code, comments, strings and templates as one piece each, words, and single signs.
PIECE = re.compile(r"```[\w-]*|/\*[\s\S]*?(?:\*/|$)|//[^\n]*|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|[\w$]+|=>|[^\s\w$]")
DECLARING = {"function": "function", "class": "class", "const": "const", "let": "const", "var": "const", "type": "type", "interface": "type", "enum": "type", "namespace": "type"}
BEFORE_TAG = frozenset("return default case yield await typeof".split())
#: What a specifier of a file of the same repository may stand for, likeliest first.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
FACTS = "fact string, name string, local string, specifier string, kind string, type_only boolean, doc string"


def unquoted(piece: str) -> str | None:
    return piece[1:-1] if piece[:1] in "'\"`" and len(piece) > 1 else None


def doc_of(comment: str) -> str:
    """The first paragraph of a documentation comment."""
    lines = [line.strip().lstrip("*").strip() for line in comment[3:].removesuffix("*/").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    stop = next((i for i, line in enumerate(lines) if not line or line.startswith("@")), len(lines))
    return " ".join(lines[:stop])


class Reader:
    """The pieces of one file without its comments, and the documentation that stands right before each."""

    def __init__(self, text: str) -> None:
        self.pieces: list[str] = []
        self.docs: dict[int, str] = {}
        for m in PIECE.finditer(text):
            piece = m.group()
            if piece.startswith("/**") and piece != "/**/":
                self.docs[len(self.pieces)] = doc_of(piece)
            elif not piece.startswith(("//", "/*", "```")):
                self.pieces.append(piece)

    def at(self, i: int) -> str:
        return self.pieces[i] if 0 <= i < len(self.pieces) else ""

    def braces(self, i: int, joint: str) -> tuple[list[tuple[str, str, bool]], int]:
        """(name, other name, type only) of a list in braces that starts at i, and the place after it."""
        out, item, end = [], [], i + 1
        while end < len(self.pieces) and self.at(end) != "}":
            if self.at(end) == ",":
                out.append(item)
                item = []
            else:
                item.append(self.at(end))
            end += 1
        found = []
        for words in [*out, item]:
            only = len(words) > 1 and words[0] == "type" and words[1] != joint
            words = words[1:] if only else words
            if words and re.match(r"[\w$]", words[0]):
                found.append((words[0], words[2] if len(words) > 2 and words[1] == joint else words[0], only))
        return found, end + 1


def imported(r: Reader, i: int) -> list[tuple]:
    """Facts of the import whose keyword is at i."""
    only = r.at(i + 1) == "type" and r.at(i + 2) not in ("from", ",", "=")
    k, names = i + 1 + only, []
    if (bare := unquoted(r.at(k))) is not None:
        return [("import", "", "", bare, "bare", False, None)]
    if r.at(k) == "(":
        target = unquoted(r.at(k + 1))
        return [("import", "", "", target, "dynamic", False, None)] if target is not None else []
    while r.at(k) and r.at(k) != "from" and len(names) < 10_000:
        if r.at(k) == "{":
            listed, k = r.braces(k, "as")
            names += [(n, local, "named", only or t) for n, local, t in listed]
        elif r.at(k) == "*" and r.at(k + 1) == "as":
            names.append(("*", r.at(k + 2), "namespace", only))
            k += 3
        elif r.at(k) == "=" and r.at(k + 1) == "require" and (target := unquoted(r.at(k + 3))) is not None:
            return [("import", n, local, target, "require", t, None) for n, local, _, t in names]
        elif r.at(k) == ",":
            k += 1
        elif re.match(r"[\w$]", r.at(k)):
            names.append(("default", r.at(k), "default", only))
            k += 1
        else:
            return []
    target = unquoted(r.at(k + 1))
    return [("import", n, local, target, kind, t, None) for n, local, kind, t in names] if target is not None else []


def required(r: Reader, i: int) -> list[tuple]:
    """Facts of the ``require`` call at i: what its result is bound to, if anything."""
    target = unquoted(r.at(i + 2)) if r.at(i + 1) == "(" else None
    if target is None or r.at(i - 1) == ".":
        return []
    names: list[tuple[str, str]] = []
    if r.at(i - 1) == "=":
        if r.at(i - 2) == "}":
            begin = i - 2
            while begin >= 0 and r.at(begin) != "{":
                begin -= 1
            names = [(n, local) for n, local, _ in r.braces(begin, ":")[0]]
        elif r.at(i - 3) == "import":
            return []
        elif re.match(r"[\w$]", r.at(i - 2)) and r.at(i - 3) != ".":
            names = [("default", r.at(i - 2))]
    return [("import", n, local, target, "require", False, None) for n, local in names] or [("import", "", "", target, "require", False, None)]


def exported(r: Reader, i: int) -> list[tuple]:
    """Facts of the export whose keyword is at i."""
    doc, k = r.docs.get(i), i + 1
    only = r.at(k) == "type" and r.at(k + 1) in ("{", "*")
    k += only
    if r.at(k) == "{":
        listed, end = r.braces(k, "as")
        target = unquoted(r.at(end + 1)) if r.at(end) == "from" else None
        return [("export", other, n, target, "default" if other == "default" else "type" if only or t else "list", only or t, doc) for n, other, t in listed]
    if r.at(k) == "*":
        space = r.at(k + 2) if r.at(k + 1) == "as" else ""
        target = unquoted(r.at(k + (4 if space else 2)))
        return [("export", space or "*", "*", target, "all", only, doc)] if target is not None else []
    default = r.at(k) == "default"
    k += default
    while r.at(k) in ("async", "abstract", "declare") and re.match(r"[\w$]", r.at(k + 1)):
        k += 1
    word = r.at(k)
    if word == "const" and r.at(k + 1) == "enum":
        k, word = k + 1, "enum"
    if word in DECLARING and not (default and word not in ("function", "class", "interface")):
        named = r.at(k + 1 + (r.at(k + 1) == "*"))
        if named == "{" and word in ("const", "let", "var"):
            return [("export", local, local, None, "const", False, doc) for _, local, _ in r.braces(k + 1, ":")[0]]
        if re.match(r"[\w$]", named) and named != "extends":
            return [("export", named, named, None, "default" if default else DECLARING[word], DECLARING[word] == "type", doc)]
    if default:
        while r.at(k + 1) == "." or r.at(k) == ".":
            k += 1
        inner = r.at(k)
        if r.at(k + 1) == "(":
            while r.at(k + 1) == "(" and re.match(r"[\w$]", r.at(k + 2)):  # memo(forwardRef(Field))
                k, inner = k + 2, r.at(k + 2)
                while r.at(k + 1) == ".":
                    k, inner = k + 2, r.at(k + 2)
        plain = bool(re.match(r"[A-Za-z_$]", inner)) and inner not in ("function", "class", "async", "new")
        return [("export", inner if plain else "default", inner if plain else "default", None, "default", False, doc)]
    return []


def source_facts(text: str) -> list[tuple]:
    """(fact, name, local name, specifier, kind, type only, doc) of the imports, exports and components used in a source text.

    What comments and strings hold is no fact. A component is used where a capitalised tag
    opens that doesn't follow a name, as type arguments do.
    """
    r, out = Reader(text), []
    for i, piece in enumerate(r.pieces):
        before = r.at(i - 1)
        if piece == "import" and before != ".":
            out += imported(r, i)
        elif piece == "require":
            out += required(r, i)
        elif piece == "export" and before != ".":
            out += exported(r, i)
        elif piece == "<" and re.match(r"[A-Z]", r.at(i + 1)) and (before in BEFORE_TAG or not re.match(r"[\w$)\]]", before)) and before != "<":
            out.append(("use", r.at(i + 1), r.at(i + 1), None, "tag", False, None))
    seen: dict[tuple, tuple] = {}
    for fact in out:
        seen.setdefault(fact[:4], fact)
    return list(seen.values())


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string())
    for batch in batches:
        ids, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = source_facts(text)
            ids += [i] * len(own)
            rows += own
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ids, pa.int32())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], [batch.schema.names[0], "fact", "name", "local", "specifier", "kind", "type_only", "doc"])


def facts(files: DataFrame, key: str = "id") -> DataFrame:
    """``source_facts`` of files (key, content), one row a fact; null contents have none."""
    rows = files.where("content is not null").select(key, "content")
    return rows.mapInArrow(_facts, f"{key} {rows.schema[key].dataType.simpleString()}, {FACTS}")


def component_like(name: Column) -> Column:
    """Whether an exported name can be a component: a capital first, and not all capitals."""
    return name.rlike("^[A-Z]") & ~name.rlike("^[A-Z0-9_$]+$") | name.rlike("^[A-Z]$")


def joined_path(folder: Column, specifier: Column) -> Column:
    """A relative specifier from a folder as a path, "." and ".." resolved; null where it leaves the tree."""
    steps = F.filter(F.split(F.concat_ws("/", folder, specifier), "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda acc, s: F.when(acc.isNull() | (s == "..") & (F.size(acc) == 0), F.lit(None)).when(s == "..", F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, s)))
    return F.array_join(walked, "/")


def resolved(imports: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, specifier, target_path, target_package) of specifiers: the file or package that they stand for.

    imports: path, specifier; files: path; packages: package, folder, entry (the path of its
    entry point, or null). A relative specifier is the first of its candidates that exists;
    another is the longest package name that it begins with, and its entry point. Modules
    from elsewhere have neither.
    """
    asked = imports.where("specifier is not null").select("path", "specifier").distinct()
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    stems = asked.where(F.col("specifier").startswith(".")).withColumn("stem", joined_path(folder, F.col("specifier")))
    bare = F.regexp_replace("stem", r"\.(?:m|c)?jsx?$", "")
    tried = F.array_distinct(F.concat(F.array(*(F.concat("stem", F.lit(s)) for s in SUFFIXES)), F.array(*(F.concat(bare, F.lit(s)) for s in SUFFIXES[1:4]))))
    near = stems.select("path", "specifier", F.posexplode(tried).alias("rank", "target_path")).join(files.select(F.col("path").alias("target_path")).distinct(), "target_path")
    local = near.groupBy("path", "specifier").agg(F.min_by("target_path", "rank").alias("target_path"))
    parts = F.split("specifier", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    far = asked.where(~F.col("specifier").startswith(".")).select("path", "specifier", F.explode(heads).alias("package")).join(packages.select("package", "entry"), "package")
    whole = far.groupBy("path", "specifier").agg(F.max_by(F.struct("package", "entry"), F.length("package")).alias("p"))
    return (
        asked.join(local, ["path", "specifier"], "left").join(whole, ["path", "specifier"], "left")
        .select("path", "specifier", F.coalesce("target_path", "p.entry").alias("target_path"), F.col("p.package").alias("target_package"))
    )


def composition(found: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """(subject, predicate, object) of a repository's files: which package depends on which, what it
    exports, and which component composes which.

    found: path and the columns of ``facts``; files: path, package; packages: package, folder,
    entry. A component is named by its file and export, "path#name". A tag counts if it is
    bound by an import of a file that exports such a component, or declared beside it.
    """
    imports = found.where("fact = 'import' and not type_only").select("path", "specifier", "name", "local")
    targets = resolved(imports, files, packages)
    home = files.select("path", "package")
    parts = found.where("fact = 'export'").where(component_like(F.col("name"))).where("specifier is null and not type_only").select("path", "name", "kind", F.concat_ws("#", "path", "name").alias("component"))
    depends = targets.where("target_package is not null").join(home, "path").where("package <> target_package").select(F.col("package").alias("subject"), F.lit("depends_on_package").alias("predicate"), F.col("target_package").alias("object"))
    holds = parts.join(home, "path").select(F.col("package").alias("subject"), F.lit("exports").alias("predicate"), F.col("component").alias("object"))
    used = found.where("fact = 'use'").select("path", F.col("name").alias("tag")).distinct()
    bound = used.join(imports, (used.path == imports.path) & (used.tag == imports.local)).select(used.path, "tag", "specifier", F.col("name").alias("wanted"))
    placed = bound.join(targets, ["path", "specifier"]).where("target_path is not null")
    made = parts.select(F.col("path").alias("target_path"), F.col("name").alias("made"), "kind", F.col("component").alias("object"))
    fits = (F.col("made") == F.col("wanted")) | (F.col("wanted") == "default") & (F.col("kind") == "default")
    across = placed.join(made, "target_path").where(fits).select("path", "object")
    beside = used.join(parts.select("path", F.col("name").alias("tag"), F.col("component").alias("object")), ["path", "tag"]).select("path", "object")
    composes = across.union(beside).join(parts.select("path", F.col("component").alias("subject")), "path").where("subject <> object").select("subject", F.lit("composes").alias("predicate"), "object")
    return depends.union(holds).union(composes).distinct()
