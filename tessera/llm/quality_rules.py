"""Quality rules: a threshold table compiled into one projection of built-in expressions.

The rule on stop words knows English, French, German and Spanish: a text of 50 words or more in another
language holds none of theirs and fails it. For a corpus of other languages leave that rule out of the table,
or add their words.

Defined results: a null or empty text has no words, so it fails the base rules; repeated rows are judged
alike; an empty table gives an empty result; the input's other columns pass through judge() unchanged and
are never looked at, and measures that clash with their names get underscores in judge().
Texts are measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.support import SPACES, free_name, words_expr

#: Very frequent function words of four languages.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "a", "for", "it", "was", "as", "with", "on", "are", "be", "this", "by", "from", "at", "not", "or", "an",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "par", "sur", "pas", "au", "avec", "est", "ne",
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "von", "zu", "mit", "sich", "ist", "nicht", "auf", "für", "im", "des",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "es", "al", "lo", "como",
)
#: As they stand in sentences and at their start.
_STOP_FORMS = tuple(dict.fromkeys(f for w in STOP_WORDS for f in (w, w.capitalize())))
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """measure must lie in [least, most] for texts of at least from_words words; null is no bound."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The table. Bounds are wide of what plain prose of the four languages shows.
RULES = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0, 50),
    Rule("symbols", "symbols_per_word", None, 0.25, 20),
    Rule("exclamations", "exclamations_per_word", None, 0.5, 20),
    Rule("capitals", "capital_share", None, 0.6, 20),
    Rule("stop_words", "stop_share", 0.005, None, 50),
    Rule("repeated_lines", "dup_line_share", None, 0.6, 20),
    Rule("bullet_lines", "bullet_line_share", None, 0.9, 50),
    Rule("ellipsis_lines", "ellipsis_line_share", None, 0.5, 50),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def _count(text: Column, characters: str) -> Column:
    """Occurrences of ASCII characters, by the bytes that go when they are removed."""
    return reduce(lambda a, b: a + b, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, dict[str, str]]:
    """docs with its measures, base_failed and kept; and the names these got in the result."""
    names, out = {}, docs
    for n in ("words_", "lines_", "windows_", "repeats_", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"):
        names[n] = free_name(docs, n)
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words, lines, windows = (F.col(f"`{names[n]}`") for n in ("words_", "lines_", "windows_"))
    out = out.withColumns({names["words_"]: words_expr(t), names["lines_"]: F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")})
    # a window by the hash of its words; 64 bits, so two different windows of one text do not meet
    at = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2))))
    out = out.withColumn(names["windows_"], F.coalesce(at, F.array().cast("array<bigint>")))
    # only texts with repeats pay for the sort: equal hashes stand side by side, and their words are the union of the windows
    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.when(F.size(F.array_distinct(windows)) < F.size(windows), order)
    out = out.withColumn(names["repeats_"], repeats)
    r = F.col(f"`{names['repeats_']}`")
    hit = F.filter(r, lambda x, k: ((k > 0) & (F.get(r, k - 1)["h"] == x["h"])) | (F.get(r, k + 1)["h"].isNotNull() & (F.get(r, k + 1)["h"] == x["h"])))
    covered = F.array_distinct(F.flatten(F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))))
    n_words = F.size(words).cast("long")
    measures = {
        names["n_words"]: n_words,
        names["word_chars"]: F.length(F.array_join(words, "")).cast("long"),
        names["n_symbols"]: _count(t, SYMBOLS).cast("long"),
        names["n_dup_lines"]: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        names["n_repeat_words"]: F.coalesce(F.size(covered), F.lit(0)).cast("long"),
    }
    out = out.withColumns(measures)
    m = {k: F.col(f"`{v}`") for k, v in names.items()}
    values = {
        "n_words": m["n_words"],
        "mean_word_chars": _share(m["word_chars"], m["n_words"]),
        "symbols_per_word": _share(m["n_symbols"], m["n_words"]),
        "exclamations_per_word": _share(_count(t, "!"), m["n_words"]),
        "capital_share": _share(F.regexp_count(t, F.lit("[A-Z]")), m["word_chars"]),
        "stop_share": _share(F.size(F.filter(words, lambda w: w.isin(*_STOP_FORMS))), m["n_words"]),
        "dup_line_share": _share(m["n_dup_lines"], F.size(lines)),
        "bullet_line_share": _share(F.size(F.filter(lines, lambda x: x.rlike("^[ \\t]*([-*•]|[0-9]+[.)])[ \\t]"))), F.size(lines)),
        "ellipsis_line_share": _share(F.size(F.filter(lines, lambda x: x.rlike("(\\.\\.\\.|…)[ \\t\\r]*$"))), F.size(lines)),
    }
    base = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    fails = []
    for rule in rules:
        v = values[rule.measure]
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (v < rule.least)
        if rule.most is not None:
            bad = bad | (v > rule.most)
        fails.append(F.when((m["n_words"] >= rule.from_words) & bad, F.lit(rule.name)))
    out = out.withColumns({names["base_failed"]: base, names["failed_rules"]: F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")})
    out = out.withColumn(names["kept"], ~m["base_failed"] & (F.size(m["failed_rules"]) == 0))
    return out.drop(*(names[n] for n in ("words_", "lines_", "windows_", "repeats_"))), names
