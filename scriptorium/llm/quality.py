"""Quality rules, line first: lines that are no sentences, look like navigation, are symbol noise, shouting or boilerplate go;
a document that loses too much of its text goes with them.

Rules of a line (shares are of its non-blank characters): punctuation (no sentence end anywhere in it), navigation (several
separators, or mostly capitalised words and no end mark), symbols, exclamations, capitals, no letters, and boilerplate phrases
of English, German, French and Spanish that make up more than a share of it.

Native DataFrame functions only. Everything is per row: no shuffle, no driver state.

Defined cases: null text is an empty text (0 words, base_failed); repeated rows give repeated results; extra columns come back
as they are from clean_documents, whatever their names, while `annotate` puts its own figures in the place of columns that have
their names; very long texts are handled whole (sort-based, n log n); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_RUN, blank_words, covered, packed, unpacked, word_hashes

SYMBOLS = "#*$%&|<>"
#: Rule thresholds: shares in percent of a line's non-blank characters.
MAX_SYMBOLS, MAX_EXCLAMATIONS, MAX_UPPER, SHOUT_CHARS = 8, 10, 60, 12
#: A document goes when its failed lines hold more than this share of its non-blank characters.
MAX_LOST = 50
#: Boilerplate phrases (fixed values) and the share of a line from which they make it boilerplate.
PHRASES = (
    "a(ll rights reserved|lle rechte vorbehalten|viso legal)|c(ookies?|lick here|opyright|onditions d.utilisation)|datenschutzerkl.rung|en savoir plus"
    "|i(mpressum|niciar sesi.n)|j(avascript|etzt anmelden)|l(og ?in|icensed under|eer m.s)|m(ehr erfahren|entions l.gales)|nutzungsbedingungen"
    "|p(rivacy policy|owered by|olitique de confidentialit.|ol.tica de privacidad)|read more|s(ubscribe|ign up|e connecter)"
    "|t(erms of (use|service)|ous droits r.serv.s|odos los derechos reservados|.rminos y condiciones)|weiterlesen"
)
BOILERPLATE = r"(?i)(^|[^\p{L}\p{N}])(" + PHRASES + r")([^\p{L}\p{N}]|\z)"
MAX_BOILERPLATE = 10
#: A sentence end within a line; an end mark of a line; words in capitals; separators between words (fixed values).
SENTENCE = r"[.!?…。！？؟۔][\"'”»)\]]*([\x20\x09-\x0D]|\z)"
END_MARK = r"[.!?…。！？؟۔:;,\"'”»)\]][\x20\x09-\x0D]*\z"
CAPITALISED = r"(^|[\x20\x09-\x0D])\p{Lu}"
SEPARATOR = r"[\x20\x09-\x0D][|›»•·/>]([\x20\x09-\x0D]|\z)"
#: Navigation: at least so many separators; or so many words, of which this share is capitalised.
MIN_SEPARATORS, NAV_WORDS, NAV_CAPITALISED = 2, 3, 80
WINDOW = 5


def _count(text: Column, kept: str) -> Column:
    """Code points of text that match the negated class `kept` (what is outside goes first)."""
    return F.length(F.regexp_replace(text, kept, ""))


def _solid(text: Column) -> Column:
    """text without blanks."""
    plain = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(text.rlike(r"[\t\x0B-\x0D]"), F.regexp_replace(text, BLANK_RUN, "")).otherwise(plain)


def _matches(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), 0))


def line_fails(line: Column) -> Column:
    """Whether a line (with at least one word) breaks a rule. Shares are of its non-blank code points."""

    # what most lines decide at once stands first in each rule; what is costly is computed for the others only
    def rules(line, x):
        n, words = F.length(x), _matches(line, r"[^\x20\x09-\x0D]+")
        symbols, shouts, upper = _count(x, r"[^#*$%&|<>~^=•»›]+"), _count(x, r"[^!]+"), _count(x, r"\P{Lu}+")
        phrases = n - F.length(F.regexp_replace(F.regexp_replace(line, BOILERPLATE, ""), BLANK_RUN, ""))
        separated = F.lit(False)
        for c in "|›»•·/>":
            separated = separated | F.contains(line, F.lit(c))
        return (
            ~line.rlike(SENTENCE)
            | separated & (_matches(line, SEPARATOR) >= MIN_SEPARATORS)
            | ~line.rlike(END_MARK) & (words >= NAV_WORDS) & (_matches(line, CAPITALISED) * 100 >= words * NAV_CAPITALISED)
            | x.rlike(r"[#*$%&|<>~^=•»›]") & (symbols * 100 > n * MAX_SYMBOLS)
            | F.contains(x, F.lit("!")) & (shouts * 100 > n * MAX_EXCLAMATIONS) & (shouts > 2)
            | (n >= SHOUT_CHARS) & (upper * 100 > n * MAX_UPPER)
            | ~x.rlike(r"\p{L}")
            | line.rlike(BOILERPLATE) & (phrases * 100 > n * MAX_BOILERPLATE)
        )

    return F.transform(F.array(_solid(line)), lambda x: rules(line, x))[0]


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_words and n_repeat_words to a frame with __ws (words): words in 5-word windows found twice or more.

    Windows are sorted as one long each: hash bits above, position bits below. Equal hash bits give candidates,
    which are compared as texts, so a hash collision changes nothing.
    """
    n, mask, s = F.col("__n"), F.col("__mask"), F.col("__sorted")
    df = df.withColumns({"__n": F.size("__ws"), "__wh": word_hashes(F.col("__ws"))})
    df = df.withColumn("__mask", F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ceil(F.log2(n + F.lit(2))).cast("int")) - F.lit(1))
    hashed = F.transform(
        F.sequence(F.lit(0), n - F.lit(WINDOW)),
        lambda i: F.xxhash64(*[F.get(F.col("__wh"), i + F.lit(k)) for k in range(WINDOW)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")),
    )
    df = df.withColumn("__packed", F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    df = df.withColumn("__sorted", F.sort_array("__packed"))
    differ = lambda a, b: F.coalesce(F.get(s, a).bitwiseXOR(F.get(s, b)).bitwiseAND(F.bitwise_not(mask)) != 0, F.lit(True))
    close = F.filter(F.sequence(F.lit(0), F.size(s) - F.lit(1)), lambda k: ~differ(k, k + F.lit(1)) | ~differ(k, k - F.lit(1)))
    df = df.withColumn("__close", F.when(F.size(s) > 1, close).otherwise(F.array().cast("array<int>")))
    text_at = F.transform(
        F.col("__close"),
        lambda k: F.transform(F.array(F.get(s, k).bitwiseAND(mask).cast("int")), lambda i: F.struct(F.array_join(F.slice(F.col("__ws"), i + F.lit(1), F.lit(WINDOW)), " ").alias("t"), i.alias("i")))[0],
    )
    df = df.withColumn("__exact", F.when(F.size("__close") > 0, F.sort_array(text_at)))
    x = F.col("__exact")
    found = F.filter(x, lambda e, k: (e["t"] == F.coalesce(F.get(x, k + F.lit(1))["t"], F.lit(""))) | (e["t"] == F.coalesce(F.get(x, k - F.lit(1))["t"], F.lit(""))))
    df = df.withColumn("__starts", F.when(x.isNotNull(), F.sort_array(F.transform(found, lambda e: e["i"]))))
    return df.withColumns({"n_words": n.cast("bigint"), "n_repeat_words": F.coalesce(covered(F.col("__starts"), WINDOW), F.lit(0).cast("bigint"))})


OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned"]


def _figures(df: DataFrame) -> DataFrame:
    """df (row, text) with the rule figures, `cleaned` (text without failed lines), `lost_chars`, `base_failed` and `kept`."""
    t = F.coalesce(F.col("text"), F.lit(""))
    df = df.select("row", t.alias("__t"), blank_words(F.col("text")).alias("__ws"), F.split(t, "\n").alias("__lines"))
    df = df.withColumns({
        "word_chars": F.length(_solid(F.col("__t"))).cast("bigint"),
        "n_symbols": F.when(F.col("__t").rlike("[#*$%&|<>]"), F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", ""))).otherwise(0).cast("bigint"),
        "__full": F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "__ok": F.filter("__lines", lambda x: ~x.rlike(r"[^\x20\x09-\x0D]") | ~line_fails(x)),
    })
    df = df.withColumns({
        "n_dup_lines": (F.size("__full") - F.size(F.array_distinct("__full"))).cast("bigint"),
        "cleaned": F.array_join("__ok", "\n"),
    })
    df = _repeats(df)
    lost = F.col("word_chars") - F.length(_solid(F.col("cleaned")))
    df = df.withColumn("lost_chars", F.when(F.size("__ok") == F.size("__lines"), F.lit(0).cast("bigint")).otherwise(lost))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))
    # the row number keeps a filter on `kept` from being pushed below, into a copy of all the expressions it stands on
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST) & (F.monotonically_increasing_id() >= 0))
    return df.select("row", *OWN)


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the figures of OWN; columns of docs with these names give way to them."""
    found = _figures(docs.select(F.struct(*[docs[f"`{c}`"].alias(c) for c in docs.columns]).alias("row"), docs[f"`{text}`"].alias("text")))
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in OWN], *OWN)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Kept documents, their failed lines removed, n_chars brought up to date; the columns of docs."""
    out = _figures(packed(docs)).where("kept")
    return unpacked(out, docs.columns, {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("bigint")})


def op2(docs: DataFrame) -> DataFrame:
    return annotate(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
