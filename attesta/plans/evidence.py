"""Queries over cited source text and documents: spans, refusals, source facts, context files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text
from attesta.operators import anchors, extract, ingest, source_code, spans, statements
from attesta.sources.tables import keyed, table

COLUMNS = ("path", "lines", "repo", "commit_sha", "url", "span_text", "enclosing_symbol", "scip_symbol", "cited_at")


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(spark, folder, "evidence", "evidence_id", *COLUMNS)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder).where("span_text is not null").select(F.col("evidence_id").alias("id"), F.col("span_text").alias("content"))


def span_digest(spark: SparkSession, folder: str) -> DataFrame:
    return spans.digests(_evidence(spark, folder)).where("digest is not null").select("evidence_id", "digest", "norm_lines")


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    evidence = table(spark, folder, "evidence")
    cited = evidence.where("path is not null and size(lines) = 2").select("evidence_id", "repo", "path", "lines", "enclosing_symbol", "span_text")
    anchors = spans.digests(cited).drop("span_text").dropDuplicates(["evidence_id"])  # copies go once the text is a digest
    return spans.check(anchors, spans.latest_files(evidence))


def span_check(spark: SparkSession, folder: str) -> DataFrame:
    """Every citation against the newest text known of its file."""
    return _checked(spark, folder).select("evidence_id", "state", "moved_from", "moved_to")


def healed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that shifted citations should name from now on."""
    return _checked(spark, folder).where("healed is not null").select("evidence_id", F.col("healed")[0].alias("from_line"), F.col("healed")[1].alias("to_line"))


def anchor_states(spark: SparkSession, folder: str) -> DataFrame:
    evidence = keyed(spark, folder, "evidence", "evidence_id", "repo")
    counted = _checked(spark, folder).join(evidence, "evidence_id").groupBy("repo")
    return counted.agg(
        F.count(F.lit(1)).alias("anchors"), *[F.count_if(F.col("state") == s).alias(s) for s in ("ok", "shifted", "changed", "gone")], F.bool_or(F.col("state").isin("changed", "gone")).alias("needs_reverification"))


def reverification_queue(spark: SparkSession, folder: str) -> DataFrame:
    return spans.queue(_checked(spark, folder), keyed(spark, folder, "evidence", "evidence_id", "repo", "cited_at"))


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Citations that a claim's literal may not quote."""
    return ingest.accepted(_evidence(spark, folder), "span_text").where("error is not null").select("evidence_id")


def accepted_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted and refused citations of each repository."""
    rows = ingest.accepted(_evidence(spark, folder), "span_text")
    return rows.groupBy("repo").agg(F.count(F.when(F.col("error").isNull(), 1)).alias("accepted"), F.count("error").alias("refused"))


def url_redaction(spark: SparkSession, folder: str) -> DataFrame:
    """Citations with a password in an address, and the text without it."""
    rows = _evidence(spark, folder).select("evidence_id", "span_text", text.url_hidden(F.col("span_text")).alias("hidden"))
    return rows.where("span_text <> hidden").select("evidence_id", F.sha2("hidden", 256).alias("hidden_sha"))


def scip_parse(spark: SparkSession, folder: str) -> DataFrame:
    rows = _evidence(spark, folder).select("evidence_id", text.scip_parts(F.col("scip_symbol")).alias("s")).where("s is not null")
    return rows.select("evidence_id", "s.*")


def identifier_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Strong identifiers in what is cited: addresses, resources and paths."""
    said = F.explode(F.array_compact(F.array("url", "tf_address", "path", "span_text")))
    rows = keyed(spark, folder, "evidence", "evidence_id", "url", "tf_address", "path", "span_text").select("evidence_id", said.alias("said"))
    found = rows.select("evidence_id", text.identifier(F.col("said")).alias("i")).where("i is not null")
    return found.select("evidence_id", "i.authority", "i.value").distinct()


def source_exports(spark: SparkSession, folder: str) -> DataFrame:
    return extract.exports(_files(spark, folder))


def source_imports(spark: SparkSession, folder: str) -> DataFrame:
    return extract.imports(_files(spark, folder))


def source_components(spark: SparkSession, folder: str) -> DataFrame:
    return extract.components(_files(spark, folder))


def source_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the cited files of each repository hold and use, and how their components are composed."""
    cited = _evidence(spark, folder).where("path is not null and span_text is not null")
    files = cited.groupBy("repo", "path").agg(F.max_by("span_text", F.struct("cited_at", "evidence_id")).alias("content")).select(F.concat_ws("/", "repo", "path").alias("path"), F.coalesce("repo", F.lit("")).alias("package"), "content")
    packages = files.groupBy("package").agg(F.lit("").alias("folder"), F.lit(None).cast("string").alias("entry"))
    return source_code.composition(source_code.facts(files, "path"), files, packages)


def unparsed_clauses(spark: SparkSession, folder: str) -> DataFrame:
    """How many clauses of each document make no claim."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return statements.unparsed(texts).groupBy("id").agg(F.count(F.lit(1)).alias("clauses"))


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    return extract.front_matter(table(spark, folder, "documents").select("doc_id", "text"))


def context_paths(spark: SparkSession, folder: str) -> DataFrame:
    return extract.context_paths(_evidence(spark, folder).where("path is not null").select("path").distinct())


def freshness_commits(spark: SparkSession, folder: str) -> DataFrame:
    """For each pair of files cited in a repository's folder: commits on the first and not on the last by name."""
    cited = _evidence(spark, folder).where("path is not null and repo is not null")
    full = cited.select(F.concat_ws("/", "repo", "path").alias("path"), F.concat_ws("/", "repo", F.regexp_replace("path", "/[^/]*$", "")).alias("folder"), F.col("commit_sha").alias("commit"))
    last = full.groupBy("folder").agg(F.max("path").alias("context"))
    pairs = full.select("folder", F.col("path").alias("described")).distinct().join(last, "folder").where("described <> context").select("described", "context")
    return extract.commits_behind(full.select("path", "commit"), pairs)


def citation_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Cited files of each repository; a file that is cited with an address counts as named explicitly."""
    evidence = _evidence(spark, folder)
    return extract.source_citations(evidence, evidence.where("url is not null").select("repo", "path").distinct())


def text_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Claims that the documents' sentences make."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    return statements.statements(texts).distinct()


def ingested_statements(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' claims taken in as one batch: for each predicate the assertions, different claims, those that mint an entity, and refusals."""
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "written_at")
    said = statements.statements(texts).join(texts.select("id", "written_at"), "id")
    rows = said.select(F.sha2(F.concat_ws("|", "id", "subject", "predicate", "object", "polarity"), 256).alias("key"), "subject", "predicate", "object", "polarity", F.lit("human").alias("method"), F.col("written_at").alias("created_at"))
    taken = ingest.batch(rows, keyed(spark, folder, "entity", "id", "canonical_id", "kind", "env", "display_name"))
    return taken.groupBy("predicate").agg(F.count("fingerprint").alias("assertions"), F.count_distinct("fingerprint").alias("claims"), F.count_if("minted").alias("minting"), F.count("error").alias("refused"))


def predicate_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents as a raw predicate, on the vocabulary where it is known."""
    words = table(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}_]+")).alias("raw")).where("raw <> ''")
    return ingest.resolve_predicates(words).select("raw", "predicate", "unmapped", "hits")


def word_stems(spark: SparkSession, folder: str) -> DataFrame:
    """Stems of the documents' words with the words that share them."""
    words = table(spark, folder, "documents").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("length(word) > 2")
    return words.groupBy(text.stem(F.col("word")).alias("stem")).agg(F.count_distinct("word").alias("words"), F.count(F.lit(1)).alias("uses"))


def yes_no(spark: SparkSession, folder: str) -> DataFrame:
    """What each document's text would mean as an answer."""
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.yes_no(F.col("text")).alias("answer"))


def source_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Files that a scan would read in each repository, by language."""
    paths = _evidence(spark, folder).where("path is not null").select("repo", "path").distinct()
    return extract.scanned(paths).groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"))


def question_intents(spark: SparkSession, folder: str) -> DataFrame:
    """What each document would ask for as a question: a template, a kind of thing, and whether it asks for a list."""
    t = F.col("text")
    return table(spark, folder, "documents").where("text is not null").select(
        "doc_id", text.first_of(t, text.INTENTS, "data_provenance").alias("template"), text.first_of(t, text.KIND_WORDS, None).alias("kind"), t.rlike(text.LISTING).alias("listing"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return keyed(spark, folder, "mention", "mention_id", "raw").select(F.col("mention_id").alias("question_id"), F.col("raw").alias("text"))


def named_in_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """(mention_id, id): entities of whose names every word, by its stem, is in a mention, in any order."""
    names = keyed(spark, folder, "entity", "id", "canonical_id", "display_name").where("canonical_id = id").select("id", text.norm_name(F.col("display_name")).alias("name_norm"))
    asked = _questions(spark, folder).select("question_id", text.norm_name(F.col("text")).alias("asked"))
    return anchors.by_words(asked, names).select(F.col("question_id").alias("mention_id"), "id")


def question_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """The five entities that each mention, taken as a question, names best."""
    return anchors.anchors(_questions(spark, folder), keyed(spark, folder, "entity", "id", "canonical_id", "env", "display_name"))


def new_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions of the last day, as a batch, without those that the days before have delivered."""
    rows = table(spark, folder, "mention").where("seen_at is not null").select("mention_id", "seen_at")
    day = F.to_date("seen_at")
    last = rows.agg(F.max(day).alias("last"))
    flagged = rows.crossJoin(F.broadcast(last))  # one row
    return ingest.unseen(flagged.where(day == F.col("last")).select("mention_id"), flagged.where(day < F.col("last")).select("mention_id"), "mention_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            span_digest, span_check, healed_lines, anchor_states, reverification_queue, secret_scan, accepted_literals, url_redaction, scip_parse, identifier_extract, source_exports, source_imports, source_components, source_facts, unparsed_clauses,
            front_matter, context_paths, freshness_commits, citation_counts, text_statements, ingested_statements, predicate_resolve, word_stems, yes_no, source_languages, question_intents, named_in_mentions, question_anchors, new_mentions,
        )
    }


def _norm_line(c: str) -> str:
    for pattern, by in ((r"\s+", " "), ("[''`‘’“”]", '"'), (r"[;,]+\s*$", ""), (r"^\s+|\s+$", "")):
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return c


RAW = "raw as (select distinct on (evidence_id) * from evidence)"


def _lines(c: str) -> str:
    split = rf"regexp_split_to_array({c}, '\r?\n')"
    return f"list_filter(list_transform(range(1, len({split}) + 1), lambda i: {{'line': i, 'text': {_norm_line(f'{split}[i]')}}}), lambda x: length(x.text) > 0)"


def _digest(lines: str) -> str:
    return f"case when len({lines}) > 0 then sha256(array_to_string(list_transform({lines}, lambda x: x.text), chr(10))) end"


CHECKED = f"""{RAW},
anchored as (select evidence_id, repo, path, lines, enclosing_symbol, {_lines('span_text')} as mine from raw where path is not null and len(lines) = 2),
anchors as (select *, {_digest('mine')} as digest, case when len(mine) > 0 then len(mine) end as n from anchored),
newest as (select repo, path, arg_max(span_text, (cited_at, evidence_id)) as content, arg_max(lines, (cited_at, evidence_id))[1] as starts from raw where path is not null and span_text is not null and len(lines) = 2 group by repo, path),
files as (select repo, path, content, list_transform({_lines('content')}, lambda x: {{'line': x.line + starts - 1, 'text': x.text}}) as file from newest),
compared as (
  select evidence_id, content, digest, n, enclosing_symbol, file, list_filter(file, lambda x: x.line between lines[1] and lines[2]) as there,
    list_position(list_transform(range(1, greatest(len(file) - n + 2, 1)), lambda i: sha256(array_to_string(list_transform(file[i : i + n - 1], lambda x: x.text), chr(10)))), digest) as place
  from anchors a left join files f on f.path = a.path and f.repo is not distinct from a.repo),
checked as (
  select evidence_id, place, n, file, case when content is null then 'gone' when digest is null then 'unchecked' when len(there) = n and {_digest('there')} = digest then 'ok'
    when place > 0 then 'shifted' when contains(content, enclosing_symbol) then 'changed' else 'gone' end as state
  from compared)"""


def oracle_sql() -> dict[str, str]:
    from attesta.operators.extract import IGNORED, LANGUAGES, SKIPPED, SOURCE
    from attesta.plans.catalogue import norm
    from attesta.sources.vocabulary import alias_rows, predicate_rows

    secret = " or ".join(f"regexp_matches(span_text, '{p}')" for p in text.SECRET_FORMS)
    flat = r"regexp_replace(regexp_replace(scip_symbol, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
    vocabulary = ", ".join(f"('{n}', '{n}')" for n, _, _ in predicate_rows()) + ", " + ", ".join(f"('{a}', '{n}')" for a, n in alias_rows() if a not in {n for n, _, _ in predicate_rows()})

    def case(column: str, patterns: tuple, other: str) -> str:
        return "case " + " ".join(f"when regexp_matches({column}, '{p}') then '{name}'" for p, name in patterns) + f" else {other} end"

    def kept(pattern: str, forms: tuple[str, ...]) -> str:
        value = f"regexp_extract(t, {quote(pattern)})"
        for form in forms:
            was, by = text.FORMS[form]
            value = f"lower({value})" if form == "lower" else f"regexp_replace({value}, {quote(was)}, {quote(by.replace('$', chr(92)))})"
        return f"regexp_replace(regexp_replace({value}, '[.,;]+$', ''), '{chr(92)}.git$', '')" if "repository" in forms else value

    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    identified = "case " + " ".join(f"when regexp_matches(t, {quote(p)}) then {{'authority': '{a}', 'value': {kept(p, f)}}}" for a, p, f in text.IDENTIFIERS) + " end"

    def stem(c: str) -> str:
        y = f"regexp_replace({c}, 'ies$', 'y')"
        return f"case when length({y}) > 2 and {y} like '%s' then left({y}, length({y}) - 1) else {y} end"

    def stems(c: str) -> str:
        return f"list_distinct(list_transform(list_filter(string_split({norm(c)}, '-'), lambda w: w <> ''), lambda w: {stem('w')}))"

    clean = "regexp_replace(regexp_replace(path, '^\\./', ''), '/+$', '')"
    folder = f"case when contains({clean}, '/') then regexp_replace({clean}, '/[^/]*$', '') end"
    index = f"regexp_matches({clean}, '(^|/)index\\.[A-Za-z0-9]+$')"
    files = f"list_filter([regexp_replace({clean}, '\\.[A-Za-z0-9]+$', '') || '.context.md', {clean} || '.context.md', case when {index} then {folder} || '/context.md' end, case when {index} then {folder} || '.context.md' end, {folder} || '/context.md'], lambda x: x is not null)"
    candidates = f"case when regexp_matches({clean}, '\\.[A-Za-z0-9]+$') then {files} else [{clean} || '/context.md', {clean} || '.context.md'] end"
    return {
        "span_digest": f"with {RAW}, l as (select evidence_id, {_lines('span_text')} as mine from raw) select evidence_id, {_digest('mine')} as digest, len(mine) as norm_lines from l where len(mine) > 0",
        "span_check": f"with {CHECKED} select evidence_id, state, case when state = 'shifted' then file[place].line end as moved_from, case when state = 'shifted' then file[place + n - 1].line end as moved_to from checked",
        "healed_lines": f"with {CHECKED} select evidence_id, file[place].line as from_line, file[place + n - 1].line as to_line from checked where state = 'shifted'",
        "anchor_states": f"""with {CHECKED} select repo, count(*) as anchors, count(*) filter (where state = 'ok') as ok, count(*) filter (where state = 'shifted') as shifted, count(*) filter (where state = 'changed') as changed,
  count(*) filter (where state = 'gone') as gone, bool_or(state in ('changed', 'gone')) as needs_reverification from checked join raw using (evidence_id) group by repo""",
        "reverification_queue": f"""with {CHECKED} select evidence_id, repo, state, row_number() over (partition by repo order by case state when 'gone' then 0 else 1 end, cited_at desc nulls last, evidence_id) as place
  from checked join raw using (evidence_id) where state in ('changed', 'gone')""",
        "secret_scan": f"with {RAW} select evidence_id from raw where {secret}",
        "accepted_literals": f"with {RAW} select repo, count(*) filter (where not coalesce({secret}, false)) as accepted, count(*) filter (where {secret}) as refused from raw group by repo",
        "url_redaction": rf"with {RAW}, h as (select evidence_id, span_text, regexp_replace(span_text, '(://[^:@/\s]*):[^@/\s]+@', '\1:***@', 'g') as hidden from raw) select evidence_id, sha256(hidden) as hidden_sha from h where hidden <> span_text",
        "scip_parse": f"""with {RAW}, p as (select evidence_id, {flat} as s, string_split({flat}, ' ') as w from raw where scip_symbol is not null)
select evidence_id, w[1] as scheme, w[2] as manager, w[3] as package, w[4] as version, array_to_string(w[5:], ' ') as descriptors from p where len(w) >= 5 and s not like 'local %'""",
        "source_exports": rf"""with {RAW}, said as (select evidence_id as id, unnest(regexp_extract_all(span_text, 'export[\s\x{{A0}}]+(?:async[\s\x{{A0}}]+)?(?:function|class|const|let|var|type|interface)[\s\x{{A0}}]+[\w$]+')) as said from raw)
select id, regexp_extract(said, '([\w$]+)$', 1) as name, case when contains(said, 'function') then 'function' when regexp_matches(said, '[\s\x{{A0}}]class[\s\x{{A0}}]') then 'class' when regexp_matches(said, '[\s\x{{A0}}](type|interface)[\s\x{{A0}}]') then 'type' else 'const' end as kind from said group by all""",
        "front_matter": r"""with lines as (select doc_id, unnest(regexp_split_to_array(regexp_extract(text, '^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)', 1), '\r?\n')) as line from documents where text like '---%'),
kv as (select doc_id, replace(lower(regexp_extract(line, '^([A-Za-z_][\w-]*)\s*:', 1)), '-', '_') as key, regexp_replace(regexp_replace(regexp_extract(line, '^[A-Za-z_][\w-]*\s*:\s*(.*)$', 1), '\s+$', ''), '^[''"]|[''"]$', '', 'g') as value from lines)
select * from kv where key <> '' and value <> ''""",
        "context_paths": f"""with {RAW}, p as (select distinct path from raw where path is not null), c as (select path, {candidates} as list from p),
d as (select path, list_filter(list, lambda x, i: not list_contains(list[1 : i - 1], x)) as list from c)
select path, unnest(range(0, len(list)))::int as rank, unnest(list) as candidate from d""",
        "freshness_commits": f"""with {RAW}, full_paths as (select repo || '/' || path as path, repo || '/' || regexp_replace(path, '/[^/]*$', '') as folder, commit_sha from raw where path is not null and repo is not null),
last as (select folder, max(path) as context from full_paths group by 1), pairs as (select distinct path as described, context from full_paths join last using (folder) where path <> context)
select described, context, count(distinct case when commit_sha is not null and (context, commit_sha) not in (select (path, commit_sha) from full_paths where commit_sha is not null) then commit_sha end) as behind
from pairs join full_paths on path = described group by all""",
        "citation_counts": f"""with {RAW} select repo, path, sum(w)::bigint as weight from (select repo, path, 1 as w from raw where path is not null and repo is not null
  union all select distinct repo, path, 1000 from raw where url is not null and path is not null and repo is not null) group by all""",
        "predicate_resolve": f"""with vocabulary(raw, name) as (values {vocabulary}), words as (select raw, count(*) as hits from (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}_]+')) as raw from documents) where raw <> '' group by 1)
select w.raw, coalesce(v.name, candidate) as predicate, v.name is null as unmapped, hits from (select *, regexp_replace(raw, '[^a-z0-9_]', '', 'g') as candidate from words) w left join vocabulary v on v.raw = candidate where candidate <> ''""",
        "word_stems": f"with words as (select unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}]+')) as word from documents) select {stem('word')} as stem, count(distinct word) as words, count(*) as uses from words where length(word) > 2 group by 1",
        "yes_no": f"select doc_id, case when regexp_matches(text, '{text.NO}') then 'no' when regexp_matches(text, '{text.YES}') then 'yes' else 'unclear' end as answer from documents where text is not null",
        "source_languages": f"""with {RAW}, p as (select distinct repo, path from raw where path is not null)
select repo, {case('path', LANGUAGES, 'null')} as language, count(*) as files from p where regexp_matches(path, '{SOURCE}') and not regexp_matches(path, '{IGNORED}') and not list_has_any(string_split(path, '/'), {list(SKIPPED)}) group by all""",
        "question_intents": f"""select doc_id, {case('text', text.INTENTS, "'data_provenance'")} as template, {case('text', text.KIND_WORDS, 'null')} as kind, regexp_matches(text, '{text.LISTING}') as listing from documents where text is not null""",
        "named_in_mentions": f"""with n as (select id, {stems('display_name')} as words from entity where canonical_id = id), q as (select mention_id, {stems('raw')} as asked from (select distinct on (mention_id) * from mention))
select mention_id, id from n join q on list_has_all(asked, words) where len(words) >= 2 and len(list_filter(words, lambda w: length(w) >= 4)) > 0""",
        "question_anchors": f"""with n as (select id, env, {norm('display_name')} as name, {stems('display_name')} as words from entity where canonical_id = id and {norm('display_name')} <> ''),
q as (select mention_id as question_id, '-' || {norm('raw')} || '-' as asked, {stems('raw')} as have from (select distinct on (mention_id) * from mention) where {norm('raw')} <> ''),
hits as (select question_id, id, round((length(name) + case when env = 'prod' then 1 else 0 end) * case when contains(asked, '-' || name || '-') then 1.0 else 0.7 end, 3)::double as score from n join q
  on contains(asked, '-' || name || '-') or len(list_filter(string_split(name, '-'), lambda w: w <> '')) >= 2 and len(list_filter(words, lambda w: length(w) >= 4)) > 0 and list_has_all(have, words))
select question_id, id, score, row_number() over (partition by question_id order by score desc, id) as rank from hits qualify rank <= 5""",
        "new_mentions": """with m as (select mention_id, (seen_at at time zone 'UTC')::date as day from mention where seen_at is not null), l as (select max(day) as last from m)
select distinct mention_id from m, l where day = last and mention_id not in (select mention_id from m, l where day < last)""",
        "identifier_extract": rf"""with {RAW}, said as (select evidence_id, regexp_replace(unnest(list_filter([url, tf_address, path, span_text], lambda x: x is not null)), '^\s+|\s+$', '', 'g') as t from raw),
found as (select evidence_id, {identified} as i from said) select distinct evidence_id, i.authority as authority, i.value as value from found where i is not null""",
    }
