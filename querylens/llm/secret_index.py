"""Operator 6, secret scans by a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams (in ASCII lower case) that every match must contain.
Documents are indexed in segments, one per Arrow batch: numpy finds all trigrams of the segment's bytes that some query names and builds
their postings; each query intersects and unites postings, and only the documents that it leaves are verified with the
expression. A rule without a mandatory trigram, such as `[0-9a-f]+`, scans every text whole. Segments are independent: no shuffle, bounded
memory, and no text leaves its task.

The base kinds are assign, access and hex as the contract fixes them: matches are leftmost and don't overlap within a kind, and those that
fail the kind's length test are dropped after matching. MORE adds private keys, whole from BEGIN to END, and tokens of known forms.

Defined results: null text is empty; spans are code points, end exclusive, and may overlap across kinds; equal starts go by kind, as
listed; a null doc_id and repeated rows are documents like others; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, load, prepare, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    flags: int = re.ASCII
    accept: Callable[[re.Match], bool] | None = None


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, lambda m: len(m[2]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", re.ASCII, lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", re.ASCII, lambda m: m.end() - m.start() >= 16),
)
#: A private key runs from its BEGIN line to the next END line, if no other BEGIN comes first.
_TO_END = r"(?:[^-]++|-(?!----(?:BEGIN|END)\x20))*+-----END\x20[^-\r\n]{0,60}-----"
#: Else to the end of its base64: header fields, then words of 16 and more after any blanks, line ends (also written \n) or quotes, or lines of base64 only;
#: behind a long word one short word on the same line, which closes a key whose line ends became blanks; and the rest of a cut END line.
_LINE = r"""[\x20\t"',;]*(?:\r\n?|\n|(?:\\r)?\\n)[\x20\t"'>#*|]*"""
_TO_LAST = (
    rf"(?:{_LINE}(?:[A-Z][A-Za-z]*-[A-Za-z-]+|Comment|Version):[^\r\n\\]*)*+"
    rf"""(?:(?:[\s"',;>#*|]|\\[nrt])*+[A-Za-z0-9+/]{{16,}}+|{_LINE}[A-Za-z0-9+/]++(?=={{0,2}}(?:["']|[\x20\t,;]*(?:[\r\n]|\\[nr]|\Z))))*+"""
    r"""(?:(?<=[A-Za-z0-9+/]{16})[\x20\t]+[A-Za-z0-9+/]++)?={0,2}(?:(?:\s|\\[nr])*-----END[A-Z\x20]*-{0,5})?"""
)
MORE = (
    Rule("pem", rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----(?:{_TO_END}|{_TO_LAST})"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
)
#: Exact sets of strings grow to this many while a query is derived; larger ones are turned into trigrams.
SET = 64

Query = tuple  # ("all",), ("tri", bytes), ("and", queries...), ("or", queries...)
ALL: Query = ("all",)


def _and(*qs: Query) -> Query:
    qs = tuple(dict.fromkeys(q for q in qs if q != ALL))
    return ALL if not qs else qs[0] if len(qs) == 1 else ("and", *qs)


def _or(*qs: Query) -> Query:
    qs = tuple(dict.fromkeys(qs))
    return ALL if ALL in qs or not qs else qs[0] if len(qs) == 1 else ("or", *qs)


def _strings(exact: frozenset[bytes]) -> Query:
    """What any of these strings requires; one under three bytes requires nothing."""
    return _or(*(_and(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) for s in sorted(exact)))


def _walk(tree) -> tuple[frozenset[bytes] | None, Query]:
    """Of a sequence of parsed nodes: the strings that it matches, if these are all, and what it requires besides."""
    run, whole, query = frozenset([b""]), True, ALL
    for op, arg in tree:
        own, more = None, ALL
        if op is C.LITERAL:
            own = frozenset([chr(arg).encode().lower()])
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg):
            own = frozenset(chr(a).encode().lower() for _, a in arg)
        elif op is C.SUBPATTERN:
            own, more = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            if all(e is not None and q == ALL for e, q in parts):
                own = frozenset().union(*(e for e, _ in parts))
            else:
                more = _or(*(_and(q, _strings(e) if e is not None else ALL) for e, q in parts))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            e, q = _walk(inner)
            if low == 0 and high == 1 and e is not None and q == ALL:
                own = e | {b""}
            elif low == high == 1:
                own, more = e, q
            elif low >= 1:
                more = _and(q, _strings(e) if e is not None else ALL)
        elif op is C.AT:
            own = frozenset([b""])
        query = _and(query, more)
        if own is not None and len(own) * len(run) <= SET:
            run = frozenset(a + b for a, b in itertools.product(run, own))
        else:
            # A gap, or too many strings: what has been gathered is required, and strings begin anew.
            query = _and(query, _strings(run))
            run, whole = own if own is not None else frozenset([b""]), False
    return (run, query) if whole else (None, _and(query, _strings(run)))


@functools.cache
def trigram_query(rule: Rule) -> Query:
    """What the bytes of a text, in ASCII lower case, must hold for the rule to match; ("all",) where nothing is mandatory."""
    exact, query = _walk(_parser.parse(rule.pattern, rule.flags))
    return query if exact is None else _and(query, _strings(exact))


def named(query: Query) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*(named(q) for q in query[1:])) if query[0] != "all" else set()


@functools.cache
def _table(trigrams: frozenset[bytes]) -> np.ndarray:
    """For each 24-bit code, the number of its trigram among the sorted ones, plus one; 0 for others."""
    out = np.zeros(1 << 24, np.uint16)
    for i, t in enumerate(sorted(trigrams)):
        out[int.from_bytes(t, "big")] = i + 1
    return out


def postings(data: np.ndarray, at: np.ndarray, trigrams: frozenset[bytes]) -> dict[bytes, np.ndarray]:
    """The segment's inverted index: for each trigram the ascending texts that hold it."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data).astype(np.uint32)
    if len(low) < 3 or not trigrams:
        return {t: np.zeros(0, np.int64) for t in trigrams}
    number = _table(trigrams)[(low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]]
    where = np.flatnonzero(number)
    doc = np.searchsorted(at, where, side="right") - 1
    inside = where + 3 <= at[doc + 1]
    number, doc = number[where[inside]], doc[inside]
    key = np.unique(number.astype(np.int64) << 32 | doc)
    edges = np.searchsorted(key >> 32, np.arange(1, len(trigrams) + 2))
    return {t: key[edges[i] : edges[i + 1]] & 0xFFFFFFFF for i, t in enumerate(sorted(trigrams))}


def candidates(query: Query, index: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Texts 0 to n - 1 that satisfy the query."""
    if query[0] == "all":
        return np.arange(n)
    if query[0] == "tri":
        return index[query[1]]
    parts = [candidates(q, index, n) for q in query[1:]]
    return functools.reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def find_spans(texts: list[str], data: np.ndarray, at: np.ndarray, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """Of each text, (start, number of the rule, end) of its spans, ascending."""
    queries = [trigram_query(r) for r in rules]
    index = postings(data, at, frozenset().union(*(named(q) for q in queries)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i, (rule, query) in enumerate(zip(rules, queries)):
        find = re.compile(rule.pattern, rule.flags).finditer
        for d in candidates(query, index, len(texts)).tolist():
            out[d] += [(m.start(), i, m.end()) for m in find(texts[d]) if rule.accept is None or rule.accept(m)]
    for x in out:
        x.sort()
    return out


def scan(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of each document (doc_id, text), base kinds first."""
    prepare(docs.sparkSession)
    rules = BASE + tuple(more)

    def run(batches):
        for batch in batches:
            found = find_spans(batch.column("text").to_pylist(), *bytes_of(batch.column("text")), rules)
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """docs with each stretch of secrets in its texts replaced by [SECRET], and n_chars of such texts brought up to date."""
    prepare(docs.sparkSession)
    rules, names = BASE + tuple(more), [f"c{i}" for i in range(len(docs.columns))]
    text, length = names[docs.columns.index("text")], names[docs.columns.index("n_chars")] if "n_chars" in docs.columns else None
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))

    def run(batches):
        for batch in batches:
            texts = batch.column(text).to_pylist()
            full = [x or "" for x in texts]
            for i, spans in enumerate(find_spans(full, *bytes_of(batch.column(text)), rules)):
                if spans:
                    parts, end = [], 0
                    for a, _, b in spans:
                        if a >= end:
                            parts += [full[i][end:a], "[SECRET]"]
                        end = max(end, b)
                    texts[i] = "".join([*parts, full[i][end:]])
            changed = {text: pa.array(texts, batch.schema.field(text).type)}
            if length:
                n = batch.column(length).to_pylist()
                changed[length] = pa.array([len(t) if t is not None and t != o else x for t, o, x in zip(texts, full, n)], batch.schema.field(length).type)
            yield pa.record_batch([changed.get(c, batch.column(c)) for c in names], names=names)

    return docs.toDF(*names).mapInArrow(run, schema).toDF(*docs.columns)


def op6_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(load(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))
    return spans.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
