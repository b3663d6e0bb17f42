"""Secret scans over a trigram inverted index. DataFrame functions only.

Each rule's regex is taken apart into a Boolean trigram query: an OR of ANDs of
trigrams that every match holds. The index has a posting (trigram, document) for
the rarest trigrams of each AND (looked_up()); postings are joined with the queries and
intersected by counting, and the candidates' texts are verified with the regex. A
rule without a mandatory trigram scans all texts. The candidates come back to their
texts by a broadcast while their counted number is at most ``FEW``, else by a join.

Spans: what stands between two matches, as split() gives it, and the matches
themselves are exploded as (document, rule, position, lengths), and a running sum
gives where each begins, in a time that grows with the matches only.

Rules ``assign``, ``access`` and ``hex`` are the base ones; the others add spans.

Defined cases: a null text is empty; empty texts have no spans; a null doc_id
stays null; repeated rows are scanned each; rows with one doc_id and different texts
are told apart by 64 bits of the text's hash; other columns have no effect; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoflume.llm._common import cut, id_back, keyed, table


@dataclass(frozen=True)
class Rule:
    """regex: as for Java and RE2. group and least: matches whose group is shorter are dropped."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"(AKIA[A-Z0-9]{16,})"),
    Rule("hex", r"([0-9a-f]{24,})"),
    Rule("github", r"(gh[pousr]_[A-Za-z0-9]{36,})"),
    Rule("slack", r"(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)"),
)
BASE = ("assign", "access", "hex")
#: Candidate documents up to which their list is broadcast.
FEW = 500_000
#: Strings that a stretch of a regex may stand for, and ANDs of a query, beyond which they aren't followed up.
MOST = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed piece matches, in lower case; None if they are more than MOST or not ASCII."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()} if arg < 128 else None
    if name == "IN":
        found: set[str] = set()
        for kind, x in arg:
            if str(kind) == "LITERAL" and x < 128:
                found.add(chr(x).lower())
            elif str(kind) == "RANGE" and x[1] < 128:
                found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return found if len(found) <= MOST // 4 else None
    if name == "SUBPATTERN":
        return _joined_strings(arg[-1])
    if name == "BRANCH":
        parts = [_joined_strings(x) for x in arg[1]]
        return set().union(*parts) if all(x is not None for x in parts) else None
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, sub = arg
        once = _joined_strings(sub) if int(high) <= 4 else None
        return None if once is None else _product([{"".join(p) for p in product(once, repeat=n)} for n in range(low, int(high) + 1)], union=True)
    return {""} if name == "AT" else None


def _product(parts: list[set[str]], union: bool = False) -> set[str] | None:
    out = set().union(*parts) if union else {"".join(p) for p in product(*parts)}
    return out if len(out) <= MOST else None


def _joined_strings(pieces) -> set[str] | None:
    out: set[str] | None = {""}
    for node in pieces:
        one = _strings(node)
        out = None if one is None or len(out) * len(one) > MOST else {a + b for a in out for b in one}
        if out is None:
            return None
    return out


#: An AND of trigrams; a query is a set of these of which one must hold, and {empty AND} holds always.
_ANY = frozenset([frozenset()])


def _least(query: set[frozenset[str]]) -> frozenset[frozenset[str]]:
    """Without the ANDs that hold only where a weaker one does."""
    if len(query) > MOST:
        return _ANY
    return frozenset(a for a in query if not any(b < a for b in query))


def _of_strings(strings: set[str]) -> frozenset[frozenset[str]]:
    return _least({frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings})


def _query(pieces) -> frozenset[frozenset[str]]:
    """What every match of the pieces, one after the other, must hold."""
    both = lambda a, b: _least({x | y for x in a for y in b}) if len(a) * len(b) <= MOST else min(a, b, key=len)
    run, out = {""}, _ANY
    for node in pieces:
        one = _strings(node)
        if one is not None and len(run) * len(one) <= MOST:
            run = {a + b for a in run for b in one}
            continue
        out, run = both(out, _of_strings(run)), {""}
        name, arg = str(node[0]), node[1]
        if one is not None:
            run = one
        elif name == "SUBPATTERN":
            out = both(out, _query(arg[-1]))
        elif name == "BRANCH":
            out = both(out, _least(set().union(*(_query(x) for x in arg[1]))))
        elif name.endswith("REPEAT") and arg[0] > 0:
            out = both(out, _query(arg[2]))
    return both(out, _of_strings(run))


def trigram_query(rule: Rule) -> list[list[str]]:
    """OR of ANDs of trigrams, in lower case, of which each match holds one AND; empty where no trigram is mandatory."""
    found = _query(re._parser.parse(rule.regex))
    return [] if frozenset() in found else sorted(sorted(x) for x in found)


#: Letters by how often they stand in text, the frequent ones first; what isn't a letter is rarer.
_OFTEN = "etaoinsrhdlucmfywgpbvkxqjz"
#: Letters from this place on are rare: one trigram with such a character, or with none but letters, is enough of an AND.
_RARE = 14


def looked_up(query: list[list[str]]) -> list[list[str]]:
    """Of each AND the trigrams that are looked up: the one that most ANDs share, of these the rarest, and the next if that is made of frequent letters. The regex verifies, so fewer only let more candidates through."""
    place = lambda c: _OFTEN.find(c) if c in _OFTEN else 40
    shared = {g: sum(g in q for q in query) for q in query for g in q}
    out = []
    for q in query:
        first = sorted(q, key=lambda g: (-shared[g], -sum(map(place, g)), g))
        out.append(sorted(first[: 1 if max(map(place, first[0])) >= _RARE else 2]))
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, tag, kinds: documents whose postings satisfy a rule's trigram query."""
    ands = [(r.kind, n, q) for r in rules for n, q in enumerate(looked_up(trigram_query(r)))]
    terms = [(kind, n, len(q), g) for kind, n, q in ands for g in q]
    wanted = F.array(*[F.lit(g) for g in sorted({t[3] for t in terms})])
    # the lower-case text is bound once: named in the inner lambda, it would be made anew for every trigram
    held = F.element_at(F.transform(F.array(F.lower("text")), lambda low: F.filter(wanted, lambda g: F.contains(low, g))), 1)
    postings = docs.select("id", "tag", F.explode(held).alias("gram"))
    query = docs.sparkSession.createDataFrame(terms, "kind string, alt int, needs int, gram string")  # as many rows as the rules have trigrams
    held = postings.join(F.broadcast(query), "gram").groupBy("id", "tag", "kind", "alt", "needs").agg(F.count_distinct("gram").alias("has"))
    return held.filter("has = needs").groupBy("id", "tag").agg(F.collect_set("kind").alias("kinds"))


def _matches(text: Column, rule: Rule) -> Column:
    """gap (characters since the match before), n (of the match), g (of the tested group) of each match."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    found = lengths(F.regexp_extract_all(text, F.lit(f"({rule.regex})"), F.lit(1)))
    tested = lengths(F.regexp_extract_all(text, F.lit(f"({rule.regex})"), F.lit(1 + rule.group))) if rule.group else found
    return F.arrays_zip(F.slice(lengths(F.split(text, rule.regex, -1)), F.lit(1), F.size(found)).alias("gap"), found.alias("n"), tested.alias("g"))


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id, tag, found (array of start, order, kind, end, sorted) of each document with a span; docs as from keyed()."""
    known = cut(candidates(docs, rules))
    few = known.limit(FEW + 1).count() <= FEW
    rows = docs.join(F.broadcast(known) if few else known, ["id", "tag"], "left")
    kinds = []
    for n, r in enumerate(rules):
        # false, not null, where a document is no candidate: null & x would scan it
        hit = F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)) if trigram_query(r) else F.lit(True)
        # the scan must not run where the index has ruled the document out
        kinds.append(F.struct(F.lit(n).alias("order"), F.when(hit & F.rlike("text", F.lit(r.regex)), _matches(F.col("text"), r)).alias("m")))
    rows = rows.select("id", "tag", F.explode(F.filter(F.array(*kinds), lambda k: k["m"].isNotNull())).alias("k"))
    rows = rows.select("id", "tag", F.col("k.order").alias("order"), F.posexplode("k.m").alias("pos", "m")).dropDuplicates(["id", "tag", "order", "pos"])
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(W.partitionBy("id", "tag", "order").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("end", end).filter(F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("order") + 1) <= F.col("m.g"))
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("order") + 1)
    one = F.struct((F.col("end") - F.col("m.n")).cast("int").alias("start"), "order", kind.alias("kind"), F.col("end").cast("int").alias("end"))
    return rows.groupBy("id", "tag").agg(F.array_sort(F.collect_list(one)).alias("found"))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _is(kind: str):
    return lambda s: s["kind"] == kind


def secret_scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<base kind>, base_sha256, spans, found (array of start, order, kind, end in code points, end exclusive)."""
    docs = keyed(documents)
    rows = docs.select("id", "tag").join(spans(docs, rules), ["id", "tag"], "left")
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    rows = rows.select("id", F.coalesce("found", none).alias("found"))
    count = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return rows.select(id_back(F.col("id")).alias("doc_id"), *count, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "found")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


def _sql() -> str:
    parts = []
    for n, r in enumerate(RULES):
        rx = r.regex.replace("'", "''")
        ok = f"len(list_extract(g, i)) >= {r.least}"
        parts.append(
            f"SELECT doc_id, s, {n} AS ord, '{r.kind}' AS kind, s + len(list_extract(m, i)) AS e FROM ("
            f"SELECT doc_id, m, g, i, (list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0))::BIGINT AS s FROM ("
            f"SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM ("
            f"SELECT doc_id, regexp_extract_all(t, '({rx})', 1) AS m, regexp_extract_all(t, '({rx})', {1 + r.group}) AS g, regexp_split_to_array(t, '{rx}') AS p FROM docs))) WHERE {ok}"
        )
    all_spans = "\nUNION ALL ".join(parts)
    base = len(BASE)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({all_spans}),
agg AS (
  SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
    coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {base}), '') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN agg a ON d.doc_id = a.doc_id"""


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE = {"op8_secret_scan": _sql()}
