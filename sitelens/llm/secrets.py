"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regular expression yields a Boolean trigram query: an OR of
clauses, each clause an AND of the trigrams that every match of that branch
contains. Postings (trigram -> texts) are built for the queried trigrams,
intersected per clause, and only the candidates are verified with the regular
expression. A rule without mandatory trigrams in some branch is scanned in full.

Defined results: null text: empty, no spans. Empty tables: no rows. Equal texts
share postings (keyed by a 64-bit hash of the text; a hash collision can only
add a candidate, which verification then rejects). Repeated rows and null ids
keep one output row each. Spans are code points, end exclusive, leftmost and
non-overlapping within a rule. Only id and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import inline_rows, text_or_empty, unused
from sitelens.session import materialize


@dataclass(frozen=True)
class Rule:
    """``regex`` in the dialect common to Java and Python; ``group`` is the part
    whose length must be at least ``least`` for a match to count."""
    kind: str
    regex: str
    group: int
    least: int
    base: bool = True


# The base rules of the scan's contract, in its order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),  # maximal runs: the same matches as [0-9a-f]+ with 16 or more
)
# Public token shapes that the method adds.
ADDED_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, base=False),
    Rule("ghtoken", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, base=False),
)
RULES = BASE_RULES + ADDED_RULES
MOST_BRANCHES = 64
RUN = 128  # matches of a text that are added together


def literal_branches(regex: str) -> list[list[str]]:
    """For each branch of the expression, the lower-cased literal runs that any
    match of the branch contains. ``None`` separates runs while walking."""
    parser = re._parser

    def walk(items) -> list[list]:
        out: list[list] = [[]]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                more = [[chr(arg).lower()]]
            elif name == "SUBPATTERN":
                more = walk(arg[3])
            elif name == "BRANCH":
                more = [b for part in arg[1] for b in walk(part)]
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, body = arg
                if low == 0:
                    more = ([[]] + walk(body)) if high == 1 and len(body) == 1 else [[None]]
                elif low == high == 1:
                    more = walk(body)
                else:  # each repetition ends with the body once more
                    more = [[None, *b, None] for b in walk(body)]
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                more = [[None]]
            else:  # classes, any character, back references
                more = [[None]]
            if len(out) * len(more) > MOST_BRANCHES:
                more = [[None]]
            out = [a + b for a in out for b in more]
        return out

    branches = []
    for marks in walk(parser.parse(regex)):
        runs, run = [], ""
        for m in [*marks, None]:
            if m is None:
                if run:
                    runs.append(run)
                run = ""
            else:
                run += m
        branches.append(runs)
    return branches


def trigram_query(regex: str) -> list[list[str]] | None:
    """Clauses of trigrams (OR of ANDs); None if some branch has no trigram."""
    clauses = [sorted({r[i:i + 3] for r in runs for i in range(len(r) - 2)}) for runs in literal_branches(regex)]
    return None if any(not c for c in clauses) else [list(c) for c in sorted({tuple(c) for c in clauses})]


def postings(docs: DataFrame, trigrams: list[str], text_col: str = "text") -> DataFrame:
    """(text_hash, trigram): which of the queried trigrams each text holds."""
    lowered = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), F.lower(F.col(text_col)).alias("lowered"))
    held = F.array_compact(F.array(*[F.when(F.contains("lowered", F.lit(t)), F.lit(t)) for t in trigrams]))
    return lowered.select("text_hash", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """(text_hash, rules): bit i is set if the text satisfies rule i's query.
    Posting lists are intersected as bit masks with partial aggregation, so
    copies of a text collapse before the shuffle and no list is collected."""
    spark = docs.sparkSession
    wanted = [{"trigram": t, "rule": i, "clause": c, "bit": 1 << b, "full": (1 << len(clause)) - 1}
              for i, r in enumerate(rules) for c, clause in enumerate(trigram_query(r.regex) or [])
              for b, t in enumerate(clause)]
    if not wanted:
        return docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), F.lit(0).cast("long").alias("rules")).where("false")
    query = inline_rows(spark, wanted).select("trigram", "rule", "clause", F.col("bit").cast("long").alias("bit"),
                                              F.col("full").cast("long").alias("full"))
    return (postings(docs, sorted({w["trigram"] for w in wanted}), text_col).join(query, "trigram")
            .groupBy("text_hash", "rule", "clause", "full").agg(F.bit_or("bit").alias("bits"))
            .where(F.col("bits") == F.col("full"))
            .groupBy("text_hash").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules")))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<s, ord, e, kind>> of the rule's matches. The pieces between
    matches give the offsets: a match starts after all earlier pieces and
    matches."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    pieces = F.split(text, rule.regex, -1)
    step = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(
        F.length(p).cast("long").alias("gap"), F.length(m).cast("long").alias("size"),
        (F.length(m if rule.group == 0 else F.regexp_extract(m, rule.regex, rule.group)) >= rule.least).alias("kept")))
    empty = F.array().cast(SPANS)

    def add(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("s"), F.lit(order).alias("ord"), (start + x["size"]).alias("e"),
                        F.lit(rule.kind).alias("kind"))
        return F.struct((start + x["size"]).alias("at"),
                        F.when(x["kept"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def add_run(acc, part):  # matches in runs: the spans so far are copied once per run, not once per match
        got = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), add)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], got["out"]).alias("out"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int")),
                       lambda i: F.slice(step, i * RUN + 1, F.lit(RUN)))
    return F.aggregate(runs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), add_run, lambda a: a["out"])


SPANS = "array<struct<s:bigint,ord:int,e:bigint,kind:string>>"
PARTS = "array<struct<from:bigint,to:bigint>>"


def with_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text",
               found: str = "secrets") -> DataFrame:
    """``docs`` with all its columns and ``found`` (a name that ``docs`` must not
    have; the others that the join needs are chosen not to clash): the spans of all rules by
    start, then rule order. Candidates are written to the shared folder first:
    verification then joins two plain tables, where a text with a third of all
    rows is split."""
    own, theirs, fits = (unused(docs, n) for n in ("own_hash", "text_hash", "fitting_rules"))
    hits = materialize(candidates(docs.select(text_or_empty(text_col).alias("text")), rules), "secret-candidates") \
        .select(F.col("text_hash").alias(theirs), F.col("rules").alias(fits))
    text = text_or_empty(text_col)
    joined = docs.withColumn(own, F.xxhash64(text)).join(hits, F.col(own) == F.col(theirs), "left")
    spans = []
    for i, r in enumerate(rules):
        may = text.rlike(r.regex)
        if trigram_query(r.regex) is not None:
            may = (F.coalesce(F.col(fits), F.lit(0).cast("long")).bitwiseAND(F.lit(1 << i).cast("long")) != 0) & may
        spans.append(F.when(may, rule_spans(text, r, i)).otherwise(F.array().cast(SPANS)))
    return joined.withColumn(found, F.array_sort(F.concat(*spans))).drop(own, theirs, fits)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"),
                                                                 x["e"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    base = [r.kind for r in rules if r.base]
    found = with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), rules, found="found")
    ours = F.filter("found", lambda x: x["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        F.col("id").alias(id_col),
        *[count(k) for k in base],
        F.sha2(span_text(ours), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"))


def redact_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]",
                   text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, every span of the text replaced by
    ``mark``; overlapping spans of different rules are replaced as one. Texts
    without spans, and null, come back as they are."""
    spans = unused(docs, "secrets")
    found = with_spans(docs, rules, text_col, spans)
    text = F.col(text_col)
    last = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(PARTS).alias("parts"))

    def outer(acc, x):  # spans that begin inside an earlier one are part of it
        fresh = x["s"] >= acc["at"]
        part = F.array(F.struct(acc["at"].alias("from"), x["s"].alias("to")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(fresh, F.concat(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"))

    def outer_run(acc, run):  # in runs: the parts so far are copied once per run, not once per span
        got = F.aggregate(run, F.struct(acc["at"].alias("at"), F.array().cast(PARTS).alias("parts")), outer)
        return F.struct(got["at"].alias("at"), F.concat(acc["parts"], got["parts"]).alias("parts"))

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / RUN).cast("int")),
                       lambda i: F.slice(spans, i * RUN + 1, F.lit(RUN)))
    kept = F.aggregate(runs, last, outer_run)
    # the text between the spans, joined once; a run's stretch of text is cut out first, because a
    # substring is found by counting characters from the start
    part_runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(kept["parts"]) - 1) / RUN).cast("int")),
                            lambda i: F.slice(kept["parts"], i * RUN + 1, F.lit(RUN)))

    def stretch(run):
        first, end = F.element_at(run, 1)["from"], F.element_at(run, -1)["to"]
        return F.struct(run.alias("run"), first.alias("first"),
                        text.substr((first + 1).cast("int"), (end - first).cast("int")).alias("text"))

    def cut(x):
        piece = lambda p: x["text"].substr((p["from"] - x["first"] + 1).cast("int"), (p["to"] - p["from"]).cast("int"))
        return F.array_join(F.transform(x["run"], lambda p: F.concat(piece(p), F.lit(mark))), "")

    cleaned = F.concat(F.array_join(F.transform(F.transform(part_runs, stretch), cut), ""),
                       text.substr((kept["at"] + 1).cast("int"), F.length(text)))
    return found.withColumn(text_col, F.when(F.size(spans) == 0, text).otherwise(cleaned)).select(*docs.columns)
