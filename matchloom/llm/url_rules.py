"""URL filter: host rules first, then pattern rules that are looked up by their rarest literal token.

A host rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's; of
those that fit, the longest text wins and gives the verdict. Other urls are judged by the pattern rules.

A pattern is a line of a public filter list: ``*`` stands for anything, ``^`` for a separator (any character
but letters, digits, ``_-.%``) or the end, ``|`` at an edge for the url's edge, ``||`` in front for the begin
of a host name's label. Case does not count. A url that a pattern fits is blocked, unless an exception (a
pattern behind ``@@``) fits too; all others are allowed.

Index: a pattern's literal tokens are the runs of letters and digits that a fitting url must have as whole
tokens. One pass over all urls counts those tokens (a row per token and task), and each pattern is filed
under its rarest. A url's tokens fetch candidates, and only their regular expressions run. Patterns without
such a token are candidates of every url.

Defined results: a url that is null or has no ``://`` has an empty host and path, so no host rule fits;
null is allowed. A url is judged by itself, so equal rows get equal results, and an empty table gives an
empty one. Without any rules every url is allowed. Other columns stay; those named as a result are
replaced. Rules are parameters, not data: ``RULE_BYTES`` bounds what goes to the tasks, more stop the job.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import unused_name

RULE_BYTES = 16_000_000
ALLOW, BLOCK = "allow", "block"
_RESULT = "struct<host string, path string, rule string, verdict string>"
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(0x41, 0x5B)})
_TOKEN = re.compile(r"[a-z0-9]+")
_SEPARATOR = r"(?:[^A-Za-z0-9_.%-]|\Z)"
_LABEL_START = r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*\.)?"


class Pattern(NamedTuple):
    """A pattern rule: its text, whether it is an exception, its regular expression and its literal tokens."""

    text: str
    exception: bool
    regex: str
    tokens: tuple[str, ...]


def pattern(text: str) -> Pattern:
    """A line of a filter list."""
    body = text.removeprefix("@@").translate(_LOWER)
    label, start = body.startswith("||"), body.startswith("|")
    body = body.lstrip("|")
    end = body.endswith("|")
    body = body.rstrip("|")
    regex = _LABEL_START if label else r"\A" if start else ""
    for c in body:
        regex += ".*" if c == "*" else _SEPARATOR if c == "^" else re.escape(c)
    tokens = []
    for run in _TOKEN.finditer(body):
        left = body[run.start() - 1] != "*" if run.start() else start
        right = body[run.end()] != "*" if run.end() < len(body) else end
        if left and right:
            tokens.append(run[0])
    return Pattern(text, text.startswith("@@"), regex + (r"\Z" if end else ""), tuple(dict.fromkeys(tokens)))


def lowered(url: str) -> str:
    """A-Z in lower case, all else as it is."""
    return url.translate(_LOWER)


def tokens_of(url: str) -> set[str]:
    """Whole tokens of a url in lower case."""
    return set(_TOKEN.findall(url))


def host_and_path(url: str | None) -> tuple[str, str]:
    """What stands behind the first ``://``: up to ``/ ? #``, and from there up to ``? #``."""
    _, mark, rest = (url or "").partition("://")
    host = re.match(r"[^/?#]*", rest)[0] if mark else ""
    return lowered(host), re.match(r"[^?#]*", rest[len(host) :])[0] if mark else ""


class HostRules:
    """Verdicts by host and path start; of equal rules the first counts."""

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self._by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, text in rules:
            host, slash, path = text.partition("/")
            self._by_host[host].append((slash + path, text, verdict))

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits and its verdict."""
        labels = host.split(".")
        names = (".".join(labels[i:]) for i in range(len(labels)))
        fit = [(text, verdict) for name in names for start, text, verdict in self._by_host.get(name, ()) if path.startswith(start)]
        return max(fit, key=lambda x: len(x[0]), default=None)


class PatternIndex:
    """Pattern rules by their rarest token; ``counts`` says how often tokens stand in the urls."""

    def __init__(self, patterns: Sequence[Pattern], counts: dict[str, int]) -> None:
        self._compiled: dict[str, re.Pattern[str]] = {}
        self._by_token: dict[str, list[Pattern]] = defaultdict(list)
        self._always: list[Pattern] = []
        for rule in patterns:
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t))
                self._by_token[rarest].append(rule)
            else:
                self._always.append(rule)

    def candidates(self, url: str) -> list[Pattern]:
        """Patterns to run on a lower-cased url."""
        return self._always + [rule for token in tokens_of(url) for rule in self._by_token.get(token, ())]

    def _fits(self, rule: Pattern, url: str) -> bool:
        regex = self._compiled.get(rule.regex)
        if regex is None:
            regex = self._compiled[rule.regex] = re.compile(rule.regex, re.DOTALL)
        return regex.search(url) is not None

    def verdict(self, url: str) -> str:
        """Blocked if a pattern fits and no exception does."""
        url = lowered(url)
        found = self.candidates(url)
        blocked = any(self._fits(rule, url) for rule in found if not rule.exception)
        return BLOCK if blocked and not any(self._fits(rule, url) for rule in found if rule.exception) else ALLOW


def token_counts(urls: DataFrame, tokens: set[str]) -> dict[str, int]:
    """In how many urls of all rows each of the tokens stands; ``urls`` has one column."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                counts.update(tokens & tokens_of(lowered(url)) if url else ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"]
        )

    if not tokens:
        return {}
    rows = urls.mapInArrow(counted, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token: r.n for r in rows.collect()}  # no more rows than tokens


def judged(pages: DataFrame, url: str, host_rules: Sequence[tuple[str, str]], patterns: Sequence[str]) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` (the host rule, else null) and ``verdict``. Only the url goes to Python."""
    size = sum(len(text) for text in (*patterns, *(text for _, text in host_rules)))
    if size > RULE_BYTES:
        raise ValueError(f"{size} characters of url rules are more than the {RULE_BYTES} that a task may hold")
    parsed = [pattern(text) for text in patterns]
    counts = token_counts(pages.select(F.col(url).cast("string")), {t for rule in parsed for t in rule.tokens})
    held: list[tuple[HostRules, PatternIndex]] = []

    def results(urls: pa.Array) -> pa.Array:
        if not held:  # once per worker
            held.append((HostRules(host_rules), PatternIndex(parsed, counts)))
        hosts, index = held[0]
        rows = []
        for value in urls.to_pylist():
            host, path = host_and_path(value)
            rule, verdict = hosts.fitting(host, path) or (None, index.verdict(value or ""))
            rows.append({"host": host, "path": path, "rule": rule, "verdict": verdict})
        text = pa.string()
        return pa.array(rows, pa.struct([("host", text), ("path", text), ("rule", text), ("verdict", text)]))

    found = F.arrow_udf(results, _RESULT)(F.col(url).cast("string"))
    names, made = ("host", "path", "rule", "verdict"), unused_name(pages, "judged")
    rest = [F.col(c) for c in pages.columns if c.lower() not in names]
    return pages.select(*rest, found.alias(made)).select(*rest, *(F.col(f"{made}.{c}") for c in names))
