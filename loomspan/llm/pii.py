"""PII: pattern spans and information-theoretic sanitisation, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four kinds (email, ip, card, phone), with the checks of their
kinds; failing matches are dropped without retries. Beyond them, terms can disclose a protected value: for a value e
and a term t (a run of `min_letters` or more letters in lower case) that stand in one document, however far apart, the
corpus gives n(e), n(t) and n(e, t), the numbers of documents with e, with t, and with both, and N, that of all documents.
With p = n(e) / (N + 1) the smoothed p(e | t) is (n(e, t) + prior p) / (n(t) + prior), and the disclosure of e by t is
ln(p(e | t) / p) / ln(1 / p): near 1 where t occurs only with e. Most values stand in one or two documents, so there is no
least count. A value of one document is disclosed by terms of next to no other document; the more documents agree, the
nearer to 1. Terms at `generalise` or more become [TERM], at `remove` or more they go, in all documents with e. Their
occurrences outside base spans are spans of kind `term`.

Counts are over all documents and whole texts, aggregated before they are shuffled. Values, terms and pairs that many
documents have are dealt to several tasks (common.split_join). Work in one document is linear in its text and its spans: positions
come from running sums over arrays in blocks (`running`), overlaps from a running maximum over ordered spans.

Null text counts as empty: no spans. Repeated rows count as documents each, and get equal spans. Values are compared in
lower case (email), by digits (card, phone) or as they stand (ip). An empty table gives an empty result; columns
other than doc_id and text are kept by `sanitise` and ignored by `spans`. Patterns have no nested backtracking, so texts
of one endless run stay linear.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import common as C

#: Kinds in their order, with patterns that match what the plain forms match: possessive quantifiers where nothing can
#: be given back, and starts inside a run left out where the run's start fails for the same reason.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a kind's pattern to be tried.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": "+"}
KINDS = [*PATTERNS, "term"]


@dataclass(frozen=True)
class Settings:
    """prior: documents with the term that are assumed besides those seen."""

    min_letters: int = 4
    prior: float = 0.5
    generalise: float = 0.9
    remove: float = 0.99


#: Arrays are gone through in blocks of so many entries, texts in blocks of so many letters.
BLOCK, LETTERS = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """The results of op over values[0..i] for every i (ints, op associative with 0 as its neutral). Copying an array for each
    entry would be quadratic, so blocks are gone through one by one, then their last results."""
    each = lambda v: F.aggregate(v, _none("int"), lambda acc, x: F.concat(acc, F.array(op(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)), x))))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / BLOCK).cast("int")), lambda k: each(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))

    def joined(local: Column) -> Column:
        ends = F.transform(local, lambda v: F.coalesce(F.try_element_at(v, F.lit(-1)), F.lit(0)))
        before = F.aggregate(ends, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
        return let(before, lambda b: F.flatten(F.transform(local, lambda v, i: F.transform(v, lambda x: op(F.get(b, i), x)))))

    return let(blocks, joined)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True where the digits of `number` pass Luhn's check."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def octets(address: Column) -> Column:
    """True where all parts are at most 255, however many zeros lead them."""
    part = F.transform(F.split(address, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(part, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (F.substring(p, 1, 3) <= "255")))


def holds(kind: str, match: Column) -> Column:
    """The check of a kind."""
    if kind == "ip":
        return octets(match)
    if kind == "card":
        return F.length(digits(match)).between(14, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(10, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of a pattern's matches, in code points: the text between matches gives starts."""

    def placed(matches: Column) -> Column:
        skips = F.transform(F.split(text, pattern, -1), lambda b: F.length(b))
        sizes = F.zip_with(F.slice(skips, F.lit(1), F.size(matches)), matches, lambda s, m: s + F.length(m))
        ends = let(sizes, lambda x: running(x, lambda a, b: a + b))
        return F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


_SPAN = "struct<start:int,kind:int,end:int,match:string>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, match>> by start, then kind (its number in KINDS)."""
    return F.array_sort(F.concat(*(_kind_spans(text, k, kind) for k, kind in enumerate(PATTERNS))))


def _kind_spans(text: Column, k: int, kind: str) -> Column:
    sign = F.contains(text, F.lit(SIGNS[kind])) if len(SIGNS[kind]) == 1 else text.rlike(SIGNS[kind])
    valid = F.filter(located(text, PATTERNS[kind]), lambda m: holds(kind, m["match"]))
    found = F.transform(valid, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["match"].alias("match")))
    return F.when(sign, found).otherwise(_none(_SPAN))


def value(span: Column) -> Column:
    """What counts as the same protected value."""
    return F.concat(span["kind"].cast("string"), F.lit(":"), F.when(span["kind"] == 0, F.lower(span["match"])).when(span["kind"] == 1, span["match"]).otherwise(digits(span["match"])))


def _words(text: Column, s: Settings) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\p{L}{%d,}+)" % s.min_letters)), lambda w: F.lower(w)))


def detect(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Materialised: uid, the columns `keep`, spans, and the text of rows with spans. uid tells rows apart that may share a doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(*keep, text.alias("__text")).withColumn("__spans", base_spans(F.col("__text")))
    return C.materialise(found.select(F.monotonically_increasing_id().alias("__uid"), *keep, "__spans", F.when(F.size("__spans") > 0, F.col("__text")).alias("__text")), "pii")


def disclosing(docs: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """Materialised (uid, term, remove): the terms to go in each row with spans.

    Values of the same documents are judged alike, so each such group is counted once (h1, h2: its hash). A term in more
    documents than `most` cannot reach the threshold whatever n(e, t) is; only the others meet the values.
    """
    held = found.where(F.size("__spans") > 0)
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    values = held.select("__uid", F.explode(F.array_distinct(F.transform("__spans", value))).alias("value"))
    groups = values.groupBy("value").agg(F.count("*").alias("ne"), F.bit_xor(F.xxhash64("__uid")).alias("h1"), F.bit_xor(F.xxhash64("__uid", F.lit(1))).alias("h2"))
    p = F.col("ne") / (F.col("total") + 1)
    most = (F.col("ne") + s.prior * p) * F.pow(p, F.lit(s.generalise - 1)) * (1 + 1e-9) - s.prior
    groups = C.materialise(groups.crossJoin(total).withColumns({"p": p, "most": most}), "values")
    of = C.split_join(values, groups, ["value"], "ne", F.xxhash64("__uid")).select("__uid", "h1", "h2", "ne", "p", "most").distinct()
    terms = docs.select(F.explode(_words(F.coalesce(F.col("text"), F.lit("")), s)).alias("term")).groupBy("term").agg(F.count("*").alias("nt"))
    limit = F.broadcast(groups.agg(F.max("most").alias("limit")))  # one row
    own = held.select("__uid", F.explode(_words(F.col("__text"), s)).alias("term"))
    # only terms of rows with spans matter, counted there as well, as these are the rows that meet them
    rare = C.materialise(own.groupBy("term").agg(F.count("*").alias("held")).join(terms.crossJoin(limit).where(F.col("nt") <= F.col("limit")).drop("limit"), "term"), "terms")
    words = C.split_join(own, rare, ["term"], "held", F.xxhash64("__uid")).select("__uid", "term", "nt")
    pairs = C.materialise(words.join(of, "__uid").where(F.col("nt") <= F.col("most")), "pairs")
    counted = pairs.groupBy("h1", "h2", "ne", "p", "term", "nt").agg(F.count("*").alias("net"))
    disclosure = F.log((F.col("net") + s.prior * F.col("p")) / (F.col("nt") + s.prior) / F.col("p")) / -F.log("p")
    risky = counted.withColumn("disclosure", disclosure).where(F.col("disclosure") >= s.generalise).select("h1", "h2", "ne", "term", "net", (F.col("disclosure") >= s.remove).alias("remove"))
    gone = C.split_join(pairs.drop("p", "nt", "most"), C.materialise(risky, "risky"), ["h1", "h2", "ne", "term"], "net", F.xxhash64("__uid"))
    return C.materialise(gone.groupBy("__uid", "term").agg(F.max("remove").alias("remove")), "gone")


def added_spans(found: DataFrame, gone: DataFrame, s: Settings) -> DataFrame:
    """(uid, more): array<struct<start, kind, end, remove>> of the terms to go outside base spans, for rows that have any."""
    some = found.join(gone.select("__uid").distinct(), "__uid", "left_semi")
    terms = some.select("__uid", F.explode(located(F.col("__text"), r"\p{L}{%d,}+" % s.min_letters)).alias("w")).select("__uid", F.lower("w.match").alias("term"), "w.start", "w.end")
    terms = terms.join(gone, ["__uid", "term"]).select("__uid", "start", "end", "remove", F.lit(True).alias("term"))
    spans = some.select("__uid", F.explode("__spans").alias("b")).select("__uid", "b.start", "b.end", F.lit(False).alias("remove"), F.lit(False).alias("term"))
    # A term meets a span just if some span that starts before the term's end ends beyond its start.
    place = F.when(F.col("term"), F.col("end")).otherwise(F.col("start"))
    order = Window.partitionBy("__uid").orderBy(place, F.col("term").desc(), "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.coalesce(F.max(F.when(~F.col("term"), F.col("end"))).over(order), F.lit(0))
    free = terms.unionByName(spans).withColumn("__reach", reach).where(F.col("term") & (F.col("__reach") <= F.col("start")))
    return free.groupBy("__uid").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", "remove"))).alias("__more"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _count_of(k: int) -> Column:
    return F.size(F.filter("__spans", lambda x: x["kind"] == k)).cast("long")


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row for each row of docs."""
    since = C.mark()
    found = detect(docs, ["doc_id"])
    gone = disclosing(docs, found, settings)
    rows = found.select("__uid", "doc_id", "__spans").join(added_spans(found, gone, settings), "__uid", "left")
    count = [_count_of(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)]
    every = F.array_sort(F.concat(_plain(F.col("__spans")), F.coalesce(_plain(F.col("__more")), _none("struct<start:int,kind:int,end:int>"))))
    out = rows.select("doc_id", *count, F.sha2(written(F.col("__spans")), 256).alias("base_sha256"), written(every).alias("spans"))
    C.tidy(since, out)
    return out


def replaced(text: Column, every: Column) -> Column:
    """text with marks in place of spans (ordered by start); where spans overlap the first one's mark stands for all.

    Pieces are cut from blocks of LETTERS letters, as a cut from the whole text would count from its start each time.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / LETTERS).cast("int")
        near = F.array_join(F.slice(blocks, first + 1, F.floor((F.greatest(b, F.lit(1)) - 1) / LETTERS).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(near, a - first * LETTERS + 1, b - a)).otherwise("")

    def put(blocks: Column, size: Column, spans_: Column, ends: Column) -> Column:
        # ends[i]: the furthest end of spans 0..i
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        one = lambda x, i: F.when(x["start"] >= before(i), F.concat(piece(blocks, before(i), x["start"]), F.when(x["remove"], F.lit("")).otherwise(F.element_at(marks, x["kind"] + 1)))).otherwise("")
        return F.concat(F.array_join(F.transform(spans_, one), ""), piece(blocks, F.coalesce(F.try_element_at(ends, F.lit(-1)), F.lit(0)), size))

    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % LETTERS), F.lit(0))
    furthest = lambda v: running(F.transform(v, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    return let(every, lambda v: let(blocks, lambda b: let(furthest(v), lambda e: put(b, F.length(text), v, e))))


def sanitise(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with their texts sanitised: base spans become [EMAIL], [IP], [CARD], [PHONE]; disclosing terms [TERM] or nothing.

    Where spans overlap the first one's mark stands for all. Rows without spans keep their text as it is (null too).
    """
    since = C.mark()
    found = detect(docs, docs.columns)
    gone = disclosing(docs, found, settings)
    base = F.transform("__spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(False).alias("remove")))
    every = F.array_sort(F.concat(base, F.coalesce(F.col("__more"), _none("struct<start:int,kind:int,end:int,remove:boolean>"))))
    rows = found.join(added_spans(found, gone, settings), "__uid", "left").withColumn("__every", every)
    out = rows.select(*[F.when(F.size("__every") > 0, replaced(F.col("text"), F.col("__every"))).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])
    C.tidy(since, out)
    return out


def op5_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(C.table(spark, sf_dir, "documents"))
