"""Credentials in code and configuration: found by unnatural strings and context, redacted in place.

Under a tokenizer's vocabulary ordinary words need few subwords and random strings many, so
characters per subword tell them apart. Every string of every text gets that score first.
The place where a string stands then sets how natural it may be: next to nothing where a
string is only assigned to some name, words with digits where a field is called a key or a
token, and anything but plain words in a password field or the user part of an address.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Values with more characters per subword than this are made of words.
NATURAL = 3.0
#: The most that a password may have, and a string that stands in no place of secrets.
PHRASE, ODD = 7.0, 2.0
#: The same as NATURAL for values of letters only, which names in code resemble most: with scattered capitals, of 20 letters or more, and others.
SCATTERED, LENGTHY, SHORT = 2.0, 2.2, 1.7

PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
PUBLIC_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*(?:PUBLIC KEY|CERTIFICATE|SIGNATURE|MESSAGE)[A-Z ]*-----.*?(?:-----END [A-Z0-9 ]+-----|\Z)", re.S)
# Forms of well-known issuers.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{16,}"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|npm_[A-Za-z0-9]{30,}|hf_[A-Za-z0-9]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,})"
)
ADDRESS = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]*://(?:(?P<user>[^\s:/@\"'<>]*):(?P<v>[^\s/\"'<>]+?)|(?P<alone>[^\s:/@\"'<>]{12,}))@(?=[\w\[$\-.])")
SCHEME = re.compile(r"(?i)\b(?P<s>basic|bearer|digest|token)\s+(?P<v>[A-Za-z0-9+/=_.~\-]{8,})")
NAME = r"(?:passwords?|passwd|passphrase|pwd|pass|pw|pin|secret|token|tok|api[_\-. ]?key|access[_\-. ]?key(?:[_\-. ]?id)?|(?:secret|private|signing|encryption|account|master|service)[_\-. ]?key|signing|auth|authorization|credentials?|creds?)"
VALUE = r"(?:\\?\"(?P<dq>(?:[^\"\\\n]|\\.)*?)\\?\"|'(?P<sq>(?:[^'\\\n]|\\.)*)'|`(?P<bq>[^`\n]*)`|(?P<bare>[^\s\"'`,;(){}\[\]<>]+))"
QUERY = re.compile(rf"(?i)(?P<k>{NAME}\w{{0,20}})=(?P<bare>[^\s&\"'<>#;]+)(?=&)|(?<=[?&])(?P<k2>\w{{0,20}}{NAME})=(?P<bq>[^\s&\"'<>#;]+)")
ASSIGNED = re.compile(rf"(?i)(?P<k>{NAME}[\w.\-]{{0,40}})[\"'`\]]?\s*(?:=>|:=|==?|:)\s*(?:[fbru](?=[\"']))?{VALUE}")
DEFAULTED = re.compile(rf"(?i)\b(?:variable|param|parameter)\s+[\"']?(?P<k>[\w.\-]*{NAME})[\"']?\s*\{{[^{{}}]{{0,200}}?\bdefault\s*=\s*(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)')")
IDENTIFIED = re.compile(r"(?i)\b(?P<k>identified (?:with \S+ )?by (?:password )?)(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)')")
ENVIRONMENT = re.compile(rf"(?im)^\s*(?:ENV|ARG|setenv|set)\s+(?P<k>\w{{0,60}}{NAME}\w*)\s+{VALUE}")
OPTION = re.compile(rf"(?i)(?<![\w-])--?(?P<k>(?:[a-z]+-)*{NAME})(?:\s+|=){VALUE}")
CALLED = re.compile(rf"(?i)(?P<k>{NAME}\w{{0,20}})\(\s*(?:(?:\"[^\"\n]*\"|'[^'\n]*')\s*,\s*)?(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)')\s*\)")
ATTRIBUTE = re.compile(rf"(?i)\b(?:key|name)\s*=\s*[\"'](?P<k>[\w.\-]*{NAME}[\w.\-]*)[\"']\s+value\s*=\s*(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)')")
REMARK = re.compile(r"(?i)\b(?P<k>password|passphrase|passwd|pwd|pw|pass|secret|token)\b(?: \w+){1,6}\s*(?::|=)\s*" + VALUE)
PAIRED = re.compile(r"\(\s*[\"'](?P<user>[\w.\-@]+)[\"']\s*,\s*(?:\"(?P<dq>[^\"\n]*)\"|'(?P<sq>[^'\n]*)')\s*\)")
# Marks of a secret's place, one for each pattern above: their names, the starts of issued forms, and what they can't do without. A text
# without any of them holds no match. Classes are wider here, as the linear-time engine's know ASCII only.
HINT = (
    rf"(?i:{NAME}|basic|bearer|digest|identified)|://[^\s/]*@|\([^\w\"']*[\"'][^\s\"']+[\"'][^\w\"']*,[^\w\"']*[\"']"
    r"|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|AIza|SG\.|npm_|hf_|eyJ|-----BEGIN"
)
KEY_START = re.compile(r"[\w.\-/]*$")
#: Strings that may be a value, digits and letters of both cases in one, digests and ids, versions and sizes, and a name before a value.
STRING = re.compile(r"[A-Za-z0-9+/_.~$!@#%^*\-]{16,}={0,2}")
MIXED = re.compile(r"(?=[^\s]*[0-9])(?=[^\s]*[a-z])(?=[^\s]*[A-Z])")
DIGEST = re.compile(r"(?i)^(?:sha\d+[-:/]|md5[-:]|0x)|^[0-9a-f]+$|^[0-9A-F]+$|^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$|[/.]\w+\.\w{1,5}$|^/?(?:[\w.]+/){2,}|^[\w.\-]+@|^\d{4}-\d\d-\d\dT")
NUMBERED = re.compile(r"(?i)^v?\d+(?:[.\-]\w+)*$|^\d+\w{1,3}$|^[a-z]+[\-_.]?v?\d+$|^\d[\d:.\-/ T]*Z?$")
NAMED_BEFORE = re.compile(r"(?P<k>[A-Za-z][\w.\-]{0,60})[\"'`\]]?\s*(?:=>|:=|=|:)\s*[\"'`]?$")
# Names of values that are random but no secret.
RANDOM = re.compile(r"(?i)commit|sha|hash|digest|checksum|etag|trace|span|request|uuid|guid|nonce|salt|iv$|public|pub$|finger|integrity|signature|thumb|cursor|revision|version|image|blob|data$|content|body|payload|sample|example|test|id$|ids$|ref$|url|uri|href|src|path|file")

PASSWORD = re.compile(r"(?i)pass(?!word_?(?:min|max|len))|pwd|identified|(?:^|[^a-z])pw(?:$|[^a-z])|passphrase|(?:^|[^a-z])pin$")
# Names whose value describes a secret but isn't one.
ABOUT = re.compile(
    r"(?i)(?:count|length|len|limit|size|min\w*|max\w*|policy|expir\w*|ttl|type|name|path|file|dir|field|header|prefix|suffix|url|uri|endpoint|at|ref|arn|version|algorithm|alg|hash|digest|enabled|required|rotation|age|days|hours|minutes|seconds|format|pattern|regex|kind|mode|provider|store|manager|class|index|id)$"
)
REFERENCE = re.compile(
    r"(?i)^\$|\$\{|\$\(|^%\w+%$|\{\{|^<|>$|^\*+$|\*{3,}|^x{3,}|x{6,}|^\.{3,}|^-+$|^_+$|^#$|^\[|process\.env|os\.environ|getenv|environ\b|^env[.:(\[]|get_?secret|vault|secretsmanager|keyring|^arn:|^ssm:|^secret:|^var\.|^local\.|^data\.|^module\.|^config\.|^settings\.|^self\.|^this\.|^ctx\.|^req\.|^args\.|^file:|^\.?\.?/[\w.\-]+/[\w.\-/]*\.\w{1,5}$|^\./|^https?:"
    r"|^(?:your|my|the|a|an|some|insert|enter|put|add|replace|change)[-_ ]|change_?me|placeholder|redacted|masked|hidden|removed|dummy|^example|example$|^todo|^tbd|^fixme|^none$|^null$|^nil$|^undefined$|^true$|^false$|^str$|^string$|^text$|^bytes$|^int$|^any$|^optional|^required$|^unset$|^empty$|^\{\w*\}$|^f?[\"']?bearer|^sha\d|^md5|^data:"
)
REPEATED = re.compile(r"(.)\1{5,}")
# Words of sentences, which a passphrase of plain words has none of.
PROSE = frozenset("and are but can cannot does enter for forgot from has have invalid may must not one our please required reset should that the this too use was wrong you your will with".split())
CALL = re.compile(r"^[\w.:]*\w\(.*\)$", re.S)


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    """The tokenizer, read once a worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Scorer:
    """Characters per subword, remembered for the strings that recur in a task."""

    def __init__(self, tokenizer, kept: int = 1 << 17) -> None:
        self.tokenizer, self.kept, self.known = tokenizer, kept, {}

    def __call__(self, value: str) -> float:
        score = self.known.get(value)
        if score is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            score = len(value) / max(1, len(self.tokenizer.encode_ordinary(value)))
            if len(value) <= 200:
                self.known[value] = score
        return score


def unnatural(value: str, score: Scorer) -> bool:
    """Whether the value is too random for a word or name: by its score, of which short values and those of letters only need a lower one."""
    digit = any(map(str.isdigit, value))
    if len(value) < 12:
        mixed = any(map(str.islower, value)) and any(map(str.isupper, value)) or bool(re.search(r"[^A-Za-z0-9]", value))
        return len(value) >= 6 and digit and mixed and any(map(str.isalpha, value)) and not NUMBERED.search(value) and score(value) < SHORT
    if digit:
        return score(value) < NATURAL
    if sum(map(str.isalpha, value)) < 0.8 * len(value):
        return False
    most = SCATTERED if len(re.findall(r"[a-z](?=[A-Z])", value)) >= 2 else LENGTHY if len(value) >= 20 else SHORT
    return score(value) <= most


def odd(value: str, score: Scorer) -> bool:
    """Whether a string that nothing but its look speaks for is random: long, of digits and letters of both cases, no digest."""
    return len(value) >= 16 and bool(MIXED.match(value)) and not DIGEST.match(value) and score(value) <= ODD


def phraselike(value: str, score: Scorer) -> bool:
    """Words with a blank between them that are a password: one of them looks like one, or four or more plain words follow each other."""
    words = value.split()
    return score(value) < PHRASE and any(passwordlike(w, score) for w in words) or len(words) >= 4 and all(re.fullmatch(r"[a-z]{3,}", w) and w not in PROSE for w in words)


def passwordlike(value: str, score: Scorer) -> bool:
    """Anything but a plain word or number: a mix of kinds of characters, or an unnatural string."""
    if len(value) < 6 or value.isdigit() or re.fullmatch(r"\d+(?:\.\d+)*[smhd%]?", value):
        return False
    digits, signs = any(c.isdigit() for c in value), bool(re.search(r"[^A-Za-z0-9]", value))
    mixed = any(c.isupper() for c in value[1:]) and any(c.islower() for c in value)
    if digits and (signs or len(value) >= 8) or signs and mixed and not re.fullmatch(r"[A-Za-z_.]+", value):
        return score(value) < PHRASE
    return len(value) >= 8 and score(value) < (2.7 if mixed else 2.0)


def is_secret(key: str, value: str, score: Scorer, quoted: bool = False) -> bool:
    """Whether the value of a named field is a credential, by the name and the value's look.

    A quoted password may hold blanks and parentheses; elsewhere they make a value an expression or prose.
    """
    key = key.strip().lower()
    if not value or REFERENCE.search(value) or REPEATED.search(value):
        return False
    if re.search(r"access[_\-. ]?key[_\-. ]?id$", key):
        return unnatural(value, score)
    if ABOUT.search(key) and not re.search(r"(?:pwd|pass(?:word|wd|phrase)?|secret|token|key)$", key) or re.search(r"public", key):
        return False
    if re.search(r"[\s()]", value):
        if not quoted or not PASSWORD.search(key) or CALL.search(value) or "\n" in value:
            return False
        return (phraselike if re.search(r"\s", value.strip()) else passwordlike)(value, score)
    if PASSWORD.search(key):
        return passwordlike(value, score)
    return unnatural(value, score)


def _value(m: re.Match) -> tuple[int, int] | None:
    for group in ("dq", "sq", "bq", "bare"):
        if group in m.re.groupindex and m.group(group) is not None:
            return m.span(group)
    return None


def _quoted(text: str, span: tuple[int, int]) -> bool:
    return span[0] > 0 and text[span[0] - 1] in "\"'`"


def secret_spans(text: str, score: Scorer, hinted: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, place) of every credential in ``text``, in order and without overlaps.

    ``hinted`` tells that some mark of a secret's place is there; without one only strings that look random by themselves are left.
    """
    found: list[tuple[int, int, str]] = []
    strings = [m.span() for m in STRING.finditer(text) if odd(m.group(), score)]
    if not hinted and not strings:
        return found
    blocked = [m.span() for m in PUBLIC_BLOCK.finditer(text)]

    def take(a: int, b: int, place: str) -> None:
        if a < b and not any(a < y and x < b for x, y, _ in found) and not any(a < y and x < b for x, y in blocked):
            found.append((a, b, place))

    if hinted:
        for m in PRIVATE_KEY.finditer(text):
            if score(m.group()) < PHRASE:
                found.append((*m.span(), "private key"))
        for m in ADDRESS.finditer(text):
            group = "v" if m.group("v") is not None else "alone"
            value = m.group(group)
            if not REFERENCE.search(value) and not REPEATED.search(value) and (group == "v" and passwordlike(value, score) or unnatural(value, score)):
                take(*m.span(group), "address")
        for m in ISSUED.finditer(text):
            if not REPEATED.search(m.group()) and score(m.group()) < NATURAL:
                take(*m.span(), "issued")
        for m in SCHEME.finditer(text):
            called = not re.search(r"\d", m.group("v")) and text[m.end() : m.end() + 20].lstrip().startswith("(")  # a type before a function's name
            if unnatural(m.group("v"), score) and not called or m.group("s").lower() == "basic" and len(m.group("v")) >= 12 and score(m.group("v")) < NATURAL:
                if not REPEATED.search(m.group("v")):
                    take(*m.span("v"), "scheme")
        for pattern in (QUERY, ATTRIBUTE, DEFAULTED, IDENTIFIED, ENVIRONMENT, OPTION, ASSIGNED, CALLED, REMARK):
            for m in pattern.finditer(text):
                span, key = _value(m), m.group("k") or m.group("k2")
                if pattern in (ASSIGNED, CALLED):
                    key = KEY_START.search(text, max(0, m.start() - 60), m.start()).group() + key
                if span and is_secret(key, text[slice(*span)], score, _quoted(text, span)):
                    take(*span, "password" if PASSWORD.search(key) else "key")
        if re.search(r"(?i)cred|auth|login|user|account", text):
            for m in PAIRED.finditer(text):
                span = _value(m)
                if span and is_secret("password", text[slice(*span)], score, _quoted(text, span)):
                    take(*span, "password")
    for a, b in strings:
        named = NAMED_BEFORE.search(text, max(0, a - 80), a)
        value = text[a:b]
        if named and not RANDOM.search(named.group("k")) and not REFERENCE.search(value) and not REPEATED.search(value):
            take(a, b, "assigned")
    return sorted(found)


def redact(text: str, spans: list[tuple], mark: str = "*") -> str:
    """``text`` with each span overwritten by as many marks; line ends stay, so offsets do too."""
    parts, at = [], 0
    for a, b, *_ in spans:
        parts += [text[at:a], re.sub(r"[^\r\n]", mark, text[a:b])]
        at = b
    return "".join([*parts, text[at:]])


def scan(vocabulary: str, pattern: str):
    """Arrow batches of (id, text) to (id, text with secrets overwritten, secrets with place and score)."""
    schema = pa.list_(pa.struct([("secret", pa.string()), ("place", pa.string()), ("per_subword", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(encoding(vocabulary, pattern))
        for batch in batches:
            hints = pc.match_substring_regex(batch.column(1), HINT).to_pylist()
            ids, redacted, secrets = [], [], []
            for key, text, hinted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), hints):
                spans = secret_spans(text, score, hinted)
                if spans:
                    ids.append(key)
                    redacted.append(redact(text, spans))
                    secrets.append([{"secret": text[a:b], "place": place, "per_subword": score(text[a:b])} for a, b, place in spans])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(redacted, pa.string()), pa.array(secrets, schema)], ["id", "redacted", "secrets"])

    return run


def credentials(texts: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(id, redacted, secrets) of each text with a credential; texts: id, text.

    ``secrets`` has each value with its place and its characters per subword. ``vocabulary``
    is the path of a rank file; by default the installed public one. Null and empty texts
    have none. Rows are only narrowed and mapped, nothing is shuffled: all strings of all
    texts are scored, and the rules of context are tried where a mark of a secret's place is.
    """
    import public_tokenizers as public

    path, pattern = vocabulary or public.path(VOCABULARY), public.PATTERN
    return texts.where("id is not null and text <> ''").select("id", "text").mapInArrow(scan(path, pattern), "id long, redacted string, secrets array<struct<secret: string, place: string, per_subword: double>>")
