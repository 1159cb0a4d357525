"""PII by information-theoretic sanitisation.

Base patterns (email, ip, card, phone) give protected entities. Terms are weighed by what they disclose of them, by co-occurrence
counts of the whole corpus and the document frequency of every term: the posterior P(protected | term) and the pointwise information
log2(P(protected | term) / P(protected)). Protected is, from the special to the general,

- an entity, or all emails of a domain: at least MIN_SUPPORT documents with both, MIN_POSTERIOR and MIN_BITS;
- the holder of an email whose local part names the term (`jane` of jane.roe@...): MIN_POSTERIOR over the documents with the term;
  no support is needed, as the entity itself is the evidence;
- that a document holds any entity, or any of a kind: MIN_CLASS_BITS and MIN_POSTERIOR by the lower end of the posterior's Wilson
  interval (Z standard errors), so that few texts prove nothing.

A term is a word of three letters or more in lower case. Codes (eight letters and digits or more with both, or long numbers) are too
rare to be counted one by one and are counted as their generalisation, the shape (`#hex40`, `#digits16`). What proves a kind is counted
over distinct texts, so that copies prove nothing; everything else over documents. A disclosing word is a span of kind `term` wherever it stands, in any document, and a code of a disclosing shape one of
kind `code`; `sanitise` removes words and generalises codes to their shapes.

Per-document work is linear: the four patterns have no start from which a long text is scanned again.
Defined cases: null text is empty; repeated rows get equal results each; an empty table gives no rows; extra columns come back as they
are from `sanitise`, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import meet, packed, stored, unpacked

KINDS = ("email", "ip", "card", "phone")
#: Documents with term and entity; P(entity | term); bits; for kinds of entities, bits and standard errors.
MIN_SUPPORT, MIN_POSTERIOR, MIN_BITS, MIN_CLASS_BITS, Z = 3, 0.5, 4.0, 3.0, 3.0
#: Disclosing terms go to the workers as a set up to so many (below 100 bytes each), are joined by shuffle beyond.
BROADCAST_TERMS = 200_000
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[^\W_]+")
NAME = re.compile(r"[a-z]{3,}")
HEX = re.compile(r"[0-9a-f]+")
CODE_CHARS = 8
DIGIT = re.compile(r"[0-9]")
FOUND = "doc_id long, th long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, n_code long, n_spans long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The pattern's matches: '@' isn't in the local part's class, so each '@' has one possible start."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) < 4 and int(x[-4:]) < 256 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if len(m[0]) <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def term(run: str) -> str | None:
    """The term that a run of letters and digits counts as: itself in lower case, or its shape."""
    if run.isalpha():
        return run.lower() if len(run) >= 3 else None
    if len(run) < CODE_CHARS or not run.isascii():
        return None
    low = run.lower()
    return f"#{'digits' if low.isdigit() else 'hex' if HEX.fullmatch(low) else 'code'}{len(low)}"


def terms(text: str, found: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of what stands outside all base spans, in order. Counts and marks both come from here."""
    ends, i = sorted((a, b) for _, a, b in found), 0
    for m in RUN.finditer(text):
        while i < len(ends) and ends[i][1] <= m.start():
            i += 1
        if (i == len(ends) or ends[i][0] >= m.end()) and (t := term(m[0])):
            yield t, m.start(), m.end()


def vocabulary(text: str, found: list[tuple[str, int, int]]) -> set[str]:
    return {t for t, _, _ in terms(text, found)} if found else {t for w in set(RUN.findall(text)) if (t := term(w))}


def _holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with an entity: its kinds, entities and domains, its terms, and those of them that an email's local part names."""
    for b in batches:
        rows = []
        for doc, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
            if isinstance(text, str) and (found := spans(text)):
                said = {(k, text[s:e].lower()) for k, s, e in found}
                mails = [x.split("@") for k, x in said if k == "email"]
                mine = vocabulary(text, found)
                named = mine & {w for m in mails for w in NAME.findall(m[0])}
                rows.append((doc, th, sorted({k for k, _ in said}), sorted({f"{k}:{x}" for k, x in said} | {f"email:@{m[1]}" for m in mails}), sorted(mine), sorted(named)))
        if rows:
            yield pd.DataFrame(rows, columns=["doc_id", "th", "k", "e", "t", "named"])


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of a batch with each term."""
    for b in batches:
        n = Counter()
        for text in b["text"]:
            if isinstance(text, str):
                n.update(vocabulary(text, spans(text)))
        if n:
            yield pd.DataFrame({"t": list(n), "n": list(n.values())})


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document with each of its terms."""
    for b in batches:
        for doc, th, text in zip(b["doc_id"], b["th"], b["text"], strict=True):
            rows = [(doc, th, t) for t in vocabulary(text, spans(text))] if isinstance(text, str) else []
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "th", "t"])


def lower_end(n: Column, of: Column) -> Column:
    """Lower end of the Wilson interval of n / of, n at most of."""
    p = F.least(n / of, F.lit(1.0))
    return (p + F.lit(Z * Z / 2) / of - F.lit(Z) * F.sqrt(p * (F.lit(1.0) - p) / of + F.lit(Z * Z / 4) / (of * of))) / (F.lit(1.0) + F.lit(Z * Z) / of)


def disclosing(docs: DataFrame) -> DataFrame:
    """(e, t, bits): what a term discloses beyond the thresholds. docs: doc_id, th, text. e is an entity, `email:@domain`, `name:term`,
    a kind, or `any`. Co-occurrence is counted over whole documents, for kinds over distinct texts; document frequencies are of all rows.

    n_et <= n_e and n_et <= n_t, so the thresholds themselves rule out entities of fewer than MIN_SUPPORT documents or more than
    2^-MIN_BITS of all, and pairs with n_t > n_e / MIN_POSTERIOR; these are not paired.
    """
    total = float(max(docs.count(), 1))
    schema = "doc_id long, th long, k array<string>, e array<string>, t array<string>, named array<string>"
    held = stored(docs.mapInPandas(_holders, schema).dropDuplicates(["doc_id", "th"]), "pii")
    has = {"any": F.lit(True)} | {k: F.array_contains("k", k) for k in KINDS}
    n_k = held.agg(*[F.count_if(c).alias(k) for k, c in has.items()]).first()
    # one row for each term of a document with an entity
    words = held.select("doc_id", "th", "named", F.explode_outer("t").alias("t")).where("t is not null")
    met = words.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("named", F.col("t"))).alias("name"))
    texts = held.dropDuplicates(["th"]).select("k", F.explode_outer("t").alias("t")).where("t is not null")
    met = met.join(texts.groupBy("t").agg(*[F.count_if(c).alias(k) for k, c in has.items()]), "t")
    df = docs.mapInPandas(_frequencies, "t string, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    # beyond n_t = n / MIN_POSTERIOR no posterior suffices
    known = stored(met.join(df, "t").where(F.col("n_t") * MIN_POSTERIOR <= F.col("n")), "weights")

    def of_class(k):
        low = lower_end(F.col(k), F.col("n_t"))
        return F.struct(F.lit(k).alias("e"), low.alias("p"), F.log2(low / F.lit(max(n_k[k], 1) / total)).alias("bits"), F.lit(MIN_CLASS_BITS).alias("least"))

    p = F.col("name") / F.col("n_t")
    named = F.struct(F.concat(F.lit("name:"), "t").alias("e"), F.least(p, F.lit(1.0)).alias("p"), F.log2(F.least(p, F.lit(1.0)) * F.lit(total) / F.greatest("name", F.lit(1))).alias("bits"), F.lit(0.0).alias("least"))
    general = known.select("t", F.explode_outer(F.array(named, *[of_class(k) for k in has])).alias("x")).where("x.p > 0").select("x.e", "t", "x.bits", "x.p", "x.least")
    general = general.where((F.col("p") >= MIN_POSTERIOR) & (F.col("bits") >= F.col("least"))).select("e", "t", "bits")

    entities = held.select("doc_id", "th", F.explode_outer("e").alias("e"))
    n_e = entities.groupBy("e").agg(F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= MIN_SUPPORT) & (F.col("n_e") <= total / 2**MIN_BITS))
    entities = stored(entities.join(n_e, "e"), "entities")
    rare = known.where(F.col("n") >= MIN_SUPPORT).select("t", "n_t")
    k = [F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), F.col("a.th") == F.col("b.th")]
    near = words.select("doc_id", "th", "t").alias("a").join(entities.select("doc_id", "th").distinct().alias("b"), k, "left_semi").join(rare, "t")
    both = entities.alias("a").join(near.alias("b"), [*k, F.col("b.n_t") * MIN_POSTERIOR <= F.col("a.n_e")])
    both = both.groupBy("a.e", "b.t", "a.n_e", "b.n_t").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= MIN_SUPPORT)
    posterior = F.least(F.col("n_et") / F.col("n_t"), F.lit(1.0))
    bits = F.log2(posterior / (F.col("n_e") / F.lit(total)))
    special = both.withColumn("bits", bits).where((posterior >= MIN_POSTERIOR) & (F.col("bits") >= MIN_BITS)).select("e", "t", "bits")
    return special.union(general)


def detect(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and digest, and `spans` with every occurrence of the terms that the method adds."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = stored(disclosing(keyed).select("t").distinct(), "terms")
    known = None
    if found.count() <= BROADCAST_TERMS:
        known = frozenset(r.t for r in found.collect())
        keyed = keyed.withColumn("wanted", F.lit(None).cast("array<string>"))
    else:
        wanted = keyed.mapInPandas(_pairs, "doc_id long, th long, t string").join(found.hint("merge"), "t")
        wanted = wanted.groupBy("doc_id", "th").agg(F.collect_set("t").alias("wanted")).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), "wanted")
        keyed = keyed.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("th") == F.col("__h")), "left").select("doc_id", "th", "text", "wanted")

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, th, text, wanted in zip(b["doc_id"], b["th"], b["text"], b["wanted"], strict=True):
                text = text if isinstance(text, str) else ""
                base = spans(text)
                said = [f"{k}:{s}:{e}" for k, s, e in base]
                mine = known if known is not None else frozenset(wanted) if wanted is not None else frozenset()
                more = [] if not mine or mine.isdisjoint(vocabulary(text, base)) else [(t, s, e) for t, s, e in terms(text, base) if t in mine]
                words = [f"term:{s}:{e}" for t, s, e in more if t[0] != "#"]
                codes = [f"code:{s}:{e}" for t, s, e in more if t[0] == "#"]
                rows.append((doc, th, *(sum(k == x for x, _, _ in base) for k in KINDS), hashlib.sha256(",".join(said).encode()).hexdigest(), ",".join(said + words + codes), len(words), len(codes), len(said) + len(more)))
            yield pd.DataFrame(rows, columns=["doc_id", "th", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "n_code", "n_spans"])

    return keyed.mapInPandas(mark, FOUND)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with each span of `detect` replaced by its kind in angle brackets, codes by their shape; overlapping spans once."""
    marks = stored(detect(docs).where("n_spans > 0").select("doc_id", "th", "spans").dropDuplicates(["doc_id", "th"]), "marks")

    @F.pandas_udf("string")
    def rewrite(text: pd.Series, said: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(text, said, strict=True):
            if t is None or not s:
                out.append(t)
                continue
            parts, end = [], 0
            for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in s.split(","))):
                if a >= end:
                    parts += [t[end:a], f"<{term(t[a:b])[1:] if kind == 'code' else kind}>"]
                end = max(end, b)
            out.append("".join([*parts, t[end:]]))
        return pd.Series(out, dtype=object)

    joined = meet(packed(docs), marks, "left", F.lit(64) + F.length("spans"))
    return unpacked(joined, docs.columns, {"text": rewrite("text", "spans")})


def op8(docs: DataFrame) -> DataFrame:
    return detect(docs).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_term", "n_code", "n_spans")
