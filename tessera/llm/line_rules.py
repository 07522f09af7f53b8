"""Line-first quality rules in DataFrame functions alone.

Every line of a text is held against punctuation, navigation and boilerplate
rules, failing lines are removed, and a document that loses too large a share of
its words is rejected. Document-level counts (repeated windows, duplicate lines,
symbols) guard the verdict. All work is row-local: no shuffle, no Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that parts words, and symbols that count as noise.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 5
#: Phrases of page furniture in the corpus's languages, matched in either case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "use of cookies", "uses cookies", "enable javascript", "click here", "sign up for", "subscribe to our",
    "lorem ipsum", "powered by", "skip to content",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "klicken sie hier",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "condiciones de uso", "haga clic aquí",
)
#: A line of a menu: up to three words, the last of which ends in a letter or digit; so many in a row make a menu.
MENU_LINE = rf"^{SPACE}*(?:{WORD}+{SPACE}+){{0,2}}{WORD}*[\p{{L}}\p{{N}}]{SPACE}*\z"
MENU_CHARS = 60
MENU_LINES = 4
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Shares of a line's words, or of its letters, from which a line fails.
MAX_SYMBOLS_PER_WORD = 0.25
MAX_UPPER_SHARE = 0.6
MAX_MARKS_PER_WORD = 0.5
#: A document is rejected from this share of lost words on.
MAX_LOST = 0.3


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def _of(pattern: str, text: Column) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def boilerplate_pattern() -> str:
    """One pattern of all phrases, at the beginning of a word and by their first letter, so that few alternatives are tried."""
    by: dict[str, list[str]] = {}
    for phrase in BOILERPLATE:
        plain = "".join(c if c.isascii() else f"[{c}{c.upper()}]" for c in phrase[1:])
        by.setdefault(phrase[0], []).append(plain)
    return "(?i)(?:^|[^a-z])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def menu_lines(lines: str) -> Column:
    """Whether each line of the array column ``lines`` has the shape of a menu's."""
    return F.transform(lines, lambda x: ~x.endswith(".") & (F.length(x) <= MENU_CHARS) & x.rlike(MENU_LINE))  # cheapest first


def _in_menu(shape: str, i: Column) -> Column:
    """Whether line ``i`` lies in a run of ``MENU_LINES`` or more lines of that shape."""
    at = lambda k: F.coalesce(F.get(shape, i + k), F.lit(False))
    runs = [reduce(Column.__and__, [at(k) for k in range(low, low + MENU_LINES) if k]) for low in range(1 - MENU_LINES, 1)]
    return at(0) & reduce(Column.__or__, runs)


def line_fails(line: Column) -> Column:
    """Whether one line breaks a rule; lines without words pass.

    Punctuation: at least three runs of "!" or "?", or as many as half its words;
    letters mostly upper case in a line of three words or more. Navigation:
    separators and symbols from a quarter of its words on. Boilerplate: a listed
    phrase. Lines of menus are told by their neighbours, in ``assess``.
    """
    words = _of(WORD + "+", line)
    upper, lower = _of(r"\p{Lu}", line), _of(r"\p{Ll}", line)
    shouts = (upper > MAX_UPPER_SHARE * (upper + lower)) & (words >= 3)
    marks = _of(r"[!?]{2,}", line)
    signs = _of(r"[#*$%&|<>»›·•]+", line)
    punctuation = (marks >= 3) & (marks >= MAX_MARKS_PER_WORD * words)
    navigation = (signs >= 1) & (signs >= MAX_SYMBOLS_PER_WORD * words)
    boilerplate = line.rlike(boilerplate_pattern())
    return shouts | punctuation | navigation | boilerplate  # words are counted only where the cheaper test holds


def _repeat_words(docs: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the word array ``_w``: words inside windows that occur twice or more.

    Windows are compared by their 64-bit hash. Sorting (hash, position) puts
    equal windows side by side; only texts with a repeated window are sorted. Each
    array is named more than once by its reader, so the optimizer keeps it as a
    column instead of inlining it into a lambda, where it would be made per element.
    """
    hashed = docs.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).withColumn(
        "_a", F.transform("_h", lambda h, i: F.xxhash64(h, *[F.get("_h", i + k) for k in range(1, WINDOW)]))
    ).withColumn("_g", F.slice("_a", 1, F.greatest(F.size("_a") - (WINDOW - 1), F.lit(0))))  # the last ones are no whole windows
    flagged = hashed.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_g")) < F.size("_g"),
            F.sort_array(F.transform("_g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).withColumn(
        "_p",
        F.sort_array(
            F.array_compact(
                F.transform(
                    "_s",
                    lambda s, k: F.when(
                        F.coalesce(F.get("_s", k - 1)["h"] == s["h"], F.lit(False))
                        | F.coalesce(F.get("_s", k + 1)["h"] == s["h"], F.lit(False)),
                        s["i"],
                    ),
                )
            )
        ),
    )
    reach = F.transform("_p", lambda p, k: F.least(F.coalesce(F.get("_p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)
    return flagged.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def assess(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one struct column ``rules`` of every count, the verdict and the cleaned text.

    A column of the name ``rules`` in ``docs`` is replaced.

    Fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long),
    base_failed, n_bad_lines, n_lost_words, kept, clean_text. Null and empty texts
    have no words and fail. A repeated row gets equal values; other columns
    pass through untouched, and none of theirs is read.
    """
    row = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    split = row.withColumn("_w", _words(F.col("_t"))).withColumn("_l", F.split("_t", "\n"))
    lines = split.withColumn("_full", F.filter("_l", lambda x: x.rlike(WORD)))
    shaped = lines.withColumn("_m", menu_lines("_l"))
    judged = shaped.withColumn("_ok", F.filter("_l", lambda x, i: ~line_fails(x) & ~_in_menu("_m", i)))
    counted = _repeat_words(judged).select(
        "_row",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _of(SYMBOL, F.col("_t")).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.size("_l") - F.size("_ok")).cast("long").alias("n_bad_lines"),
        F.array_join("_ok", "\n").alias("clean_text"),
    )
    lost = counted.withColumn(
        "n_lost_words",
        F.when(F.col("n_bad_lines") == 0, F.lit(0).cast("long")).otherwise(
            F.col("n_words") - _of(WORD + "+", F.col("clean_text"))
        ),
    ).withColumn(
        "base_failed",
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    )
    # the last term is always true; as it isn't deterministic, a caller's filter on the verdict stays
    # above this projection, where pushed below it would make every array again, inside lambdas
    kept = ~F.col("base_failed") & (F.col("n_lost_words") < MAX_LOST * F.col("n_words")) & (F.monotonically_increasing_id() >= 0)
    fields = [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "n_bad_lines", "n_lost_words", kept.alias("kept"), "clean_text",
    ]
    return lost.select("_row", F.struct(*fields).alias("rules")).select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c != "rules"], "rules"
    )


def clean(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Kept documents with failing lines removed and their length counted anew, in the columns of ``docs``."""
    whole = docs.select(F.struct("*").alias("whole"), F.col(text_col).alias("text"))
    found = assess(whole).where("rules.kept")
    new = {text_col: F.col("rules.clean_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.length("rules.clean_text").cast(docs.schema[chars_col].dataType)
    return found.select(*[new.get(c, F.col("whole")[c]).alias(c) for c in docs.columns])
