"""Personal data: patterns that seed a bootstrapped contextual extraction.

Mail addresses, IP addresses, card and phone numbers are found by shape. The words before each are a lexical pattern;
so are those before every other token that may be an identifier: groups of digits, and mail addresses in other spellings.
Patterns and the tokens they introduce form a bipartite graph on which Spark passes scores back and forth. For each
kind a pattern is as good as the share of tokens known to be of that kind among those that are known or that can't be
of it; what may be of it, but isn't known, speaks neither for nor against. Tokens that a pattern of high score introduces
are taken as identifiers of its kind, if they may be of it, and support their other patterns in the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, cut_lineage

KINDS = ("email", "ip", "card", "phone")

_MAIL_END = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_MAIL_START = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT, _BLANK, _DIGITS = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I), re.compile(r"\s"), re.compile("[0-9]+")
_AT, _GROUPS = re.compile(r"[^@\s]+(?:@|[(\[]at[)\]])[^@\s]+", re.I), re.compile(r"[0-9()./+-]+")
_MORE = re.compile(r" (?=[0-9(])[0-9()./-]+(?![^\s,;:!?\"'\]])")
_EDGES = "\"'`.,;:!?()[]{}<>#$%&*|=/\\"


@dataclass(frozen=True)
class Bootstrap:
    """How the contextual search learns; counts are of distinct tokens."""

    context_words: int = 2
    context_chars: int = 64
    min_seeds: int = 5
    min_score: float = 0.8
    smoothing: float = 1.0
    rounds: int = 3
    min_digits: int = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; leftmost non-overlapping for each kind, failing matches dropped.

    Each search is linear in the text. For mail addresses the sign @ is looked for and the local part read backwards,
    as far as the address before it; a number's dots are tried from the start of its first run of digits only.
    """
    found, upto = [], 0
    if "@" in text:
        for m in _MAIL_END.finditer(text):
            start = m.start()
            while start > upto and text[start - 1] in _MAIL_START:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                upto = m.end()
    for m in _IP.finditer(text):
        if all(len(p) < 20 and int(p) <= 255 or not p.strip("0") or (len(p) >= 20 and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255) for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def may_be(token: str) -> int:
    """The kinds that a token's characters allow, as bits; 0: none."""
    if _AT.fullmatch(token):
        return 1
    digits = sum(map(len, _DIGITS.findall(token)))
    rest = _DIGITS.sub("", token)
    if rest.strip(" ()./+-"):
        return 0
    return 2 * (rest == "...") | 4 * (12 <= digits <= 19 and not rest.strip(" -")) | 8 * (6 <= digits <= 15 and rest != "...")


def candidates(text: str, spans: list[tuple[int, int, int]], how: Bootstrap) -> list[tuple[str, str, int, int, int]]:
    """(pattern, token, kind or -1, start, end) of base spans and of other tokens that may be identifiers.

    A token goes from blank to blank; one of digits and their signs goes on over single spaces as long as such ones follow.
    """

    def pattern(start: int) -> str:
        before = text[max(0, start - how.context_chars) : start].rstrip(_EDGES + " \t")
        words = before.lower().split()[-how.context_words :]
        return " ".join(_DIGITS.sub("0", w.strip(_EDGES)) for w in words)

    out = [(pattern(a), text[a:b], kind, a, b) for kind, a, b in spans]
    taken = sorted((a, b) for _, a, b in spans)
    upto, k = 0, 0
    while m := _DIGIT.search(text, upto):
        start = m.start()
        while start > upto and not text[start - 1].isspace():
            start -= 1
        stop = _BLANK.search(text, m.start())
        end = stop.start() if stop else len(text)
        more = _MORE.match(text, end) if _GROUPS.fullmatch(text, start, end) else None
        while more:
            end = more.end()
            more = _MORE.match(text, end)
        upto = end
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] < end:
            continue
        while start < end and text[end - 1] in _EDGES:
            end -= 1
        while start < end and text[start] in _EDGES and not (text[start] == "(" and ")" in text[start:end]):
            start += 1
        token = text[start:end]
        if sum(map(len, _DIGITS.findall(token))) >= how.min_digits or _AT.fullmatch(token):
            out.append((pattern(start), token, -1, start, end))
    return out


def scan(docs: DataFrame, how: Bootstrap) -> DataFrame:
    """doc_id, text_hash, spans and found (what ``candidates`` gives) of every row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
    edge = pa.struct([("pattern", pa.string()), ("token", pa.string()), ("kind", pa.int32()), ("fits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, found = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                here = base_spans(text) if _DIGIT.search(text) else []
                spans.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in here])
                found.append([{"pattern": p, "token": t, "kind": k, "fits": may_be(t) if k < 0 else 1 << k, "start": a, "end": b} for p, t, k, a, b in candidates(text, here, how)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(edge))], ["doc_id", "text_hash", "spans", "found"])

    shape = f"doc_id {id_type}, text_hash long, spans array<struct<kind:int,start:int,end:int>>, found array<struct<pattern:string,token:string,kind:int,fits:int,start:int,end:int>>"
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(find, shape)


def score_patterns(edges: DataFrame, how: Bootstrap) -> DataFrame:
    """(pattern, kind, score) of the patterns that reach ``min_score``; edges: pattern, token, kind (-1: unknown), fits (bits of kinds)."""
    edges = cut_lineage(edges.where("pattern != ''").distinct())
    seeds, unknown = edges.where("kind >= 0").select("pattern", "token", "kind"), edges.where("kind < 0").select("pattern", "token", "fits")
    unfit = lambda k: F.sum((F.col("fits").bitwiseAND(F.lit(1 << k)) == 0).cast("int"))
    against = cut_lineage(unknown.groupBy("pattern").agg(F.array(*[unfit(k) for k in range(len(KINDS))]).alias("unfit")))
    known, good = seeds, None
    for _ in range(how.rounds):
        support = known.groupBy("pattern", "kind").agg(F.countDistinct("token").alias("n"))
        each = support.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.struct("n", (-F.col("kind")).alias("kind"))).alias("top"))
        each = each.where(F.col("top.n") >= how.min_seeds).join(against, "pattern", "left").select("pattern", (-F.col("top.kind")).alias("kind"), F.col("top.n").alias("n"), "all", "unfit")
        score = F.col("n") / (F.col("all") + F.coalesce(F.get("unfit", F.col("kind")), F.lit(0)) + how.smoothing)
        good = cut_lineage(each.select("pattern", "kind", score.alias("score")).where(F.col("score") >= how.min_score))
        met = unknown.join(bounded_broadcast(good), "pattern").where(may_have(F.col("fits"), F.col("kind")))
        reached = met.groupBy("token").agg(F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best")).select("token", (-F.col("best.kind")).alias("kind"))
        known = seeds.unionByName(unknown.join(bounded_broadcast(reached), "token").select("pattern", "token", "kind"))
    return good


def may_have(fits: Column, kind: Column) -> Column:
    """Whether the bits allow the kind."""
    return fits.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(len(KINDS))]), kind.cast("int") + 1)) != 0


def find_personal(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """Per row: doc_id, base (array of spans found by shape) and spans (those and the ones found by context).

    Spans are structs kind (index in KINDS), start and end in code points, end exclusive, sorted by kind and start. A
    span found by context never touches one found by shape. Null texts have no spans; repeated rows stay repeated.
    """
    scanned = cut_lineage(scan(docs, how))
    # only rows with candidates are spread; the array is checkpointed, so the filter on its size costs nothing
    spread = scanned.select("doc_id", "text_hash", F.explode("found").alias("x")).select("doc_id", "text_hash", "x.*")
    good = bounded_broadcast(score_patterns(spread.select("pattern", "token", "kind", "fits"), how).select("pattern", "kind"))
    more = spread.where("kind < 0").drop("kind").join(good, "pattern").where(may_have(F.col("fits"), F.col("kind")))
    more = more.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    joined = scanned.alias("s").join(more.alias("m"), F.expr("s.doc_id <=> m.doc_id and s.text_hash = m.text_hash"), "left")
    return joined.select("s.doc_id", F.col("spans").alias("base"), F.sort_array(F.concat("spans", F.coalesce("more", F.slice("spans", 1, 0)))).alias("spans"))
