"""Quality rules (line-first cleaning), DataFrame functions only.

Each line of a document passes or fails three rules; failing lines are
removed, and a document that loses too much of its text is rejected.  The
whole work is one projection over the scan: no shuffle, no Python.

* punctuation: a line with a word must hold a sentence mark (at its end or
  before a space), and marks must not swamp it;
* navigation: menu separators stand between its words;
* boilerplate: it holds a phrase of site furniture (fixed list below).

Defined results: null or empty text has no words and is rejected; repeated
rows are judged alike, each by itself; a very long text is one row of work,
linear or n log n in its words; null ids pass through; other columns of the
input, whatever their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import WHITE, id_text, let, unused

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
# The method's own parameters.
MAX_MARK_SHARE = 0.2      # of a line's characters in words
MIN_MARKS = 6             # below this many marks a line is never swamped
MIN_SEPARATORS = 3
MAX_LOST_SHARE = 0.5      # of the characters in words

SYMBOLS = r"[#*$%&|<>]"
SENTENCE = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
MARKS = r"[!-/:-@\[-`{-~]"
SEPARATORS = r"[|>»•·]+(\s|$)"
SEPARATOR_CHARS = "|>»•·"
# Phrases of site furniture, lower case, matched at word bounds.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "back to top", "click here to",
    "cookie policy", "enable javascript", "javascript is disabled", "log in to",
    "privacy policy", "sign up for our newsletter", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use",
    "this site uses cookies", "we use cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation",
    "todos los derechos reservados", "política de privacidad", "condiciones de uso",
)


def _chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(text, WHITE, ""))


def any_of(text: Column, parts) -> Column:
    """True where ``text`` contains one of ``parts``."""
    out = F.lit(False)
    for p in parts:
        out = out | text.contains(p)
    return out


def line_fails(line: Column, furniture: Column | None = None) -> Column:
    """True where a line breaks a rule; a line without a word breaks none.

    ``furniture`` false spares the phrase search: it says that the whole
    document holds none of the phrases.
    """
    furniture = F.lit(True) if furniture is None else furniture
    swamped = let(F.regexp_count(line, F.lit(MARKS)),
                  lambda n: (n >= MIN_MARKS) & (n > _chars(line) * F.lit(MAX_MARK_SHARE)))
    return line.rlike(r"[^\x20\x09-\x0D]") & (
        ~line.rlike(SENTENCE)
        | (any_of(line, SEPARATOR_CHARS) & (F.regexp_count(line, F.lit(SEPARATORS)) >= MIN_SEPARATORS))
        | swamped
        | (furniture & F.lower(line).rlike(r"\b(" + "|".join(BOILERPLATE) + r")\b")))


def repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that stand twice or more in the text.

    A window is a 64-bit hash of its words.  Only a text whose hashes are not
    all distinct is sorted; its repeated windows' starts, in order, cover
    min(8, distance to the next start) words each.
    """
    def hashes():
        return F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)),
                           lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def starts(pairs):
        same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
        found = F.filter(pairs, lambda x, i: ((i > 0) & same(x, i - 1)) | same(x, i + 1))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def covered(at):
        part = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x)

    def of(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")) \
            .otherwise(let(let(pairs, starts), covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("bigint")).otherwise(let(hashes(), of))


def _measures(text: Column) -> Column:
    def dup_lines(lines):
        real = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        return let(real, lambda r: (F.size(r) - F.size(F.array_distinct(r))).cast("bigint"))

    def measured(words, lines, furniture, chars):
        def of_clean(good):
            whole = F.size(good) == F.size(lines)
            joined = F.array_join(good, "\n")
            return F.struct(
                F.size(words).cast("bigint").alias("n_words"),
                chars.alias("word_chars"),
                F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
                dup_lines(lines).alias("n_dup_lines"),
                repeat_words(words).alias("n_repeat_words"),
                F.when(whole, text).otherwise(joined).alias("clean_text"),
                F.when(whole, chars).otherwise(_chars(joined).cast("bigint")).alias("clean_chars"))
        return let(F.filter(lines, lambda x: ~line_fails(x, furniture)), of_clean)

    return let(F.array_remove(F.split(text, WHITE), ""), lambda words:
               let(F.split(text, "\n"), lambda lines:
                   let(any_of(F.lower(text), BOILERPLATE), lambda furniture:
                       let(F.length(F.array_join(words, "")).cast("bigint"), lambda chars:
                           measured(words, lines, furniture, chars)))))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clean_text, measures, clean_chars, base_failed, kept) per row.

    ``clean_text`` is the text without the lines that failed.  ``kept`` is
    false where the base rules fail or over half of the characters in words
    went with those lines.
    """
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", _measures(F.coalesce(F.col("text"), F.lit(""))).alias("m"))
    failed = (F.col("n_words") < MIN_WORDS) | \
        (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("word_chars") - F.col("clean_chars") > F.col("word_chars") * F.lit(MAX_LOST_SHARE)
    return (rows.select("doc_id", "m.*")
            .withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~lost))


def clean(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with their cleaned text; columns as in ``docs``.

    ``length_col``, where the table has it, follows the new text's length.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hold = unused("quality", docs)
    m = F.col(hold)
    keep = (m["n_words"] >= MIN_WORDS) \
        & (m["n_repeat_words"] * 100 <= m["n_words"] * MAX_REPEAT_PERCENT) \
        & (m["word_chars"] - m["clean_chars"] <= m["word_chars"] * F.lit(MAX_LOST_SHARE))
    new = {text_col: m["clean_text"]}
    if length_col and length_col in docs.columns:
        new[length_col] = F.length(m["clean_text"]).cast(docs.schema[length_col].dataType)
    # Exploding the one struct keeps it a column: filter and new text read it, neither computes it again.
    kept = docs.select("*", F.explode(F.array(_measures(text))).alias(hold)).filter(keep)
    return kept.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])
