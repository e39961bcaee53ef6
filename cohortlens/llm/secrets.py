"""Secret scans over a trigram inverted index.

Each rule's regular expression is reduced to a Boolean query over trigrams
that every match must contain.  The postings of those trigrams are intersected
to find the candidate documents, and only they are verified with the regular
expression.  A rule without mandatory trigrams scans every text.  Everything
on the main path is a DataFrame expression.
"""

from __future__ import annotations

import re._constants as op
import re._parser as regex_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Rule:
    """``pattern`` must read the same in Python and Java; ``group`` is the part of which
    ``min_length`` code points are wanted."""

    kind: str
    pattern: str
    group: int = 0
    min_length: int = 1


# Fixed formats.  A run of the last two kinds reaches as far as it can, so
# asking for the least length inside the pattern finds the same spans as
# filtering whole runs.
BASE_RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]"""
                   r"""|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
                   r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("pem", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

# -- regex to trigram query ---------------------------------------------------
# A query is None (anything matches), a trigram, or ("all" | "any", [queries]).


def _one_char(items) -> str | None:
    """The lower-case character a class stands for, if it is one letter in either case."""
    chars = {chr(v).lower() if k is op.LITERAL else None for k, v in items}
    return chars.pop() if len(chars) == 1 else None


def _combine(how: str, parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else (how, tuple(parts))


def trigram_query(pattern: str):
    """What lower-case trigrams a text must hold to match ``pattern``."""
    def walk(items):
        parts, run = [], ""

        def close():
            nonlocal run
            parts.extend(run[i:i + 3] for i in range(len(run) - 2))
            run = ""

        def sequence(items):
            nonlocal run
            for kind, value in items:
                char = (chr(value).lower() if kind is op.LITERAL
                        else _one_char(value) if kind is op.IN else None)
                if char is not None:
                    run += char
                elif kind is op.SUBPATTERN:
                    sequence(value[3])
                elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
                    close()
                    parts.append(walk(value[2]))
                else:
                    close()
                    if kind is op.BRANCH:
                        options = [walk(x) for x in value[1]]
                        parts.append(None if None in options else _combine("any", options))

        sequence(items)
        close()
        return _combine("all", parts)

    return walk(regex_parser.parse(pattern))


def trigrams_of(query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def _holds(query, have: Column) -> Column:
    """The Boolean query over the array of a document's posted trigrams."""
    if isinstance(query, str):
        return F.array_contains(have, query)
    how, parts = query
    out = _holds(parts[0], have)
    for p in parts[1:]:
        out = (out & _holds(p, have)) if how == "all" else (out | _holds(p, have))
    return out


# -- index and scan -----------------------------------------------------------


def build_index(docs: DataFrame, trigrams: set[str]) -> DataFrame:
    """Postings ``(trigram, key)`` for the given trigrams, from columns ``(key, text)``.

    Postings are kept for the trigrams some rule names; no other would be read.
    """
    low = F.lower("text")
    found = F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t))
                                      for t in sorted(trigrams)]))
    return docs.select("key", F.explode(found).alias("trigram"))


def candidates(postings: DataFrame, rules) -> DataFrame:
    """``(key, kinds)``: the rules whose trigram query a document's postings fulfil."""
    have = F.col("have")
    per_doc = postings.groupBy("key").agg(F.collect_set("trigram").alias("have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(trigram_query(r.pattern), have), r.kind)
                                      for r in rules]))
    return per_doc.select("key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _running_sum(values: Column, stretch: int = 256) -> Column:
    """Prefix sums of an array, summed in stretches so that long arrays stay cheap."""
    empty = "cast(array() as array<bigint>)"

    def inside(chunk, start):
        return F.aggregate(chunk, F.struct(start.alias("sum"), F.expr(empty).alias("out")),
                           lambda s, x: F.struct((s["sum"] + x).alias("sum"),
                                                 F.concat(s["out"], F.array(s["sum"] + x)).alias("out")))

    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / stretch).cast("int"))),
                         lambda c: F.slice(values, c * stretch + 1, stretch))
    start = F.struct(F.lit(0).cast("long").alias("sum"),
                     F.expr("cast(array() as array<array<bigint>>)").alias("out"))

    def add(state, chunk):
        done = inside(chunk, state["sum"])
        return F.struct(done["sum"].alias("sum"),
                        F.concat(state["out"], F.array(done["out"])).alias("out"))

    return F.flatten(F.aggregate(chunks, start, add)["out"])


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """``array<struct<start, order, kind, end>>`` of the rule's matches, code points, end exclusive.

    The texts between and in the matches alternate, so their lengths add up to
    the positions.
    """
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    # total length of every gap with the match behind it
    ends = _running_sum(F.zip_with(F.transform(gaps, lambda g: F.length(g).cast("long")),
                                   F.transform(matches, lambda m: F.length(m).cast("long")),
                                   lambda g, m: g + F.coalesce(m, F.lit(0).cast("long"))))
    spans = F.zip_with(matches, ends, lambda m, e: F.struct(
        (e - F.length(m)).alias("start"), F.lit(order).alias("order"),
        F.lit(rule.kind).alias("kind"), e.alias("end"), m.alias("match")))
    size = (lambda m: F.length(m)) if rule.group == 0 else (
        lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.group)))
    good = F.filter(spans, lambda s: s["match"].isNotNull() & (size(s["match"]) >= rule.min_length))
    return F.transform(good, lambda s: F.struct(s["start"], s["order"], s["kind"], s["end"]))


_SPAN_TYPE = "array<struct<start:bigint,order:int,kind:string,end:bigint>>"


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 base=BASE_RULES, extra=EXTRA_RULES) -> DataFrame:
    """``(doc_id, n_<kind>..., base_sha256, spans, base_spans)``, one row per input row.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    by the order of the rules.  A null or empty text has no spans.  Rows that
    repeat count each by itself; a null id is a key like any other.  Other
    columns are ignored, and an empty table gives an empty result.

    Postings and documents meet on a 64-bit key of id and text; two documents
    that share a key only get verified for nothing.
    """
    rules = [*base, *extra]
    indexed = [r for r in rules if trigram_query(r.pattern) is not None]
    names = set().union(*(trigrams_of(trigram_query(r.pattern)) for r in indexed)) if indexed else set()
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    if names:
        found = candidates(stored(build_index(rows, names), "postings"), indexed)
        rows = rows.join(found, "key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    spans = {}
    for i, r in enumerate(rules):
        got = _spans(F.col("text"), r, i).cast(_SPAN_TYPE)
        if r in indexed:
            got = F.when(F.array_contains("kinds", r.kind), got)
        spans[r.kind] = F.coalesce(got, F.array().cast(_SPAN_TYPE))
    out = rows.select("doc_id", *[c.alias(f"spans_{k}") for k, c in spans.items()])
    base_spans = _joined(F.concat(*[F.col(f"spans_{r.kind}") for r in base]))
    all_spans = _joined(F.concat(*[F.col(f"spans_{r.kind}") for r in rules]))
    return out.select("doc_id",
                      *[F.size(f"spans_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in base],
                      F.sha2(base_spans, 256).alias("base_sha256"), all_spans.alias("spans"),
                      base_spans.alias("base_spans"))
