"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

Every rule is a condition with its metrics written out: the cascade is one CASE, so a row pays for rules up to the first
that rejects it. The order comes from a sample: each rule is timed and counted over it alone, and rules go by rejected
rows per second, best first. The order changes what a run costs, never which rows are kept. Metrics that a report shows
for every row are computed once, in front of the cascade, and cost its rules nothing. Everything is DataFrame functions.
"""

import re
import time
from typing import NamedTuple

from pyspark.sql import functions as F

from textharbor.session import write_and_read

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 2000

#: Bytes that part words, inside a character class.
SPACE = r"\x20\x09-\x0D"


class Rule(NamedTuple):
    """``rejects`` is a SQL condition over columns of :data:`METRICS`."""

    name: str
    rejects: str


BASE_RULES = (
    Rule("short", "n_words < 10"),
    Rule("repeated_words", "100 * n_repeat_words > 20 * n_words"),
)

OWN_RULES = (
    Rule("symbols", "4 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 4 * n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("cut_lines", "10 * n_cut_lines > 5 * n_lines and n_lines >= 4"),
    Rule("bullets", "10 * n_bullets > 9 * n_lines and n_lines >= 4"),
    Rule("few_letters", "2 * n_lettered < n_words"),
    Rule("few_words", "50 * n_distinct_words < n_words"),
)

RULES = BASE_RULES + OWN_RULES

#: Metrics of every row of the report.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Windows of five words, as hashes.
_WINDOWS = "if(size(words) < 5, array(), transform(sequence(1, size(words) - 4), i -> xxhash64(slice(words, i, 5))))"

#: Words inside windows that occur twice or more. Only texts with such windows pay for the sort: equal hashes become
#: neighbours, their places are sorted, and each adds the words that the place before it has not covered.
_REPEATED = f"""
element_at(transform(array({_WINDOWS}), windows ->
CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE
  aggregate(
    array_sort(element_at(transform(
      array(array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i)))),
      s -> transform(
        filter(sequence(0, size(s) - 1), j -> (j > 0 AND get(s, j - 1).h = get(s, j).h)
                                           OR (j < size(s) - 1 AND get(s, j + 1).h = get(s, j).h)),
        j -> get(s, j).i)), 1)),
    named_struct('n', 0L, 'last', -5),
    (a, i) -> named_struct('n', a.n + least(5, i - a.last), 'last', i),
    a -> a.n)
END), 1)
"""


#: What rules may ask for, as SQL over the columns ``body``, ``words`` and ``lines``.
METRICS = {
    "n_words": "bigint(size(words))",
    "word_chars": "bigint(char_length(array_join(words, '')))",
    "n_symbols": "bigint(regexp_count(body, '[#*$%&|<>]'))",
    "n_lines": "bigint(size(lines))",
    "n_dup_lines": "bigint(size(lines) - size(array_distinct(lines)))",
    "n_upper": "bigint(regexp_count(body, '[A-Z]'))",
    "n_cut_lines": "bigint(size(filter(lines, l -> rtrim(l) like '%...' or rtrim(l) like '%…')))",
    "n_bullets": "bigint(size(filter(lines, l -> substring(ltrim(l), 1, 1) in ('•', '*', '-', '–', '·'))))",
    "n_lettered": r"bigint(size(filter(words, w -> w rlike '\\p{L}')))",
    "n_distinct_words": "bigint(size(array_distinct(words)))",
    "n_repeat_words": _REPEATED,
}

def with_words(df, text):
    """``row`` with all columns of ``df``, and body, words and lines of the text; a null text has none."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), body.alias("body"))
    words = F.array_remove(F.split("body", f"[{SPACE}]+"), "")
    lines = F.filter(F.split("body", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    return rows.select("row", "body", words.alias("words"), lines.alias("lines"))


def with_metrics(worded, metrics=tuple(METRICS)):
    """These metrics as columns next to those of :func:`with_words`."""
    return worded.select("*", *[F.expr(METRICS[name]).alias(name) for name in metrics])


def _seconds(df):
    began = time.perf_counter()
    rejected = df.first()[0] or 0
    return time.perf_counter() - began, rejected


def measured(df, text, rules=RULES, sample_rows=SAMPLE_ROWS, known=()):
    """Rules as (rule, rejected share, seconds a row), best rejection per cost first, from a sample of ``df``.

    Words, lines and the metrics ``known`` are there already when a rule is timed, as they are in the cascade.
    """
    total = df.count()
    if not total:
        return [(rule, 0.0, 0.0) for rule in rules]
    sample = df.sample(min(1.0, 1.2 * sample_rows / total), seed=7).select(F.col(f"`{text}`").alias("text"))
    ready = with_metrics(with_words(sample.limit(sample_rows), "text").drop("row"), known)
    ready = write_and_read(ready, "quality-sample")
    rows = max(1, ready.count())
    nothing, _ = min(_seconds(ready.agg(F.sum(F.octet_length("body") + F.size("words") + F.size("lines")))) for _ in range(2))
    found = []
    for rule in rules:
        cost, rejected = _seconds(ready.agg(F.sum(F.expr(f"int({inlined(rule, known).rejects})"))))
        found.append((rule, rejected / rows, max(cost - nothing, 1e-3) / rows))
    return sorted(found, key=lambda r: (-(r[1] + 1 / rows) / r[2], r[0].name))


def inlined(rule, known=()):
    """The rule with its metrics written out, so that they are computed where the cascade gets to it and not before.

    Those in ``known`` are columns already.
    """

    def written(match):
        name = match[0]
        return f"({METRICS[name]})" if name in METRICS and name not in known else name

    return rule._replace(rejects=re.sub(r"\b[a-z_]+\b", written, rule.rejects))


def cascade(rules):
    """The name of the first rule that rejects, null for rows that pass all."""
    first = F.when(F.expr(rules[0].rejects), F.lit(rules[0].name))
    for rule in rules[1:]:
        first = first.when(F.expr(rule.rejects), F.lit(rule.name))
    return first


def judge_quality(df, text="text", rules=RULES, sample_rows=SAMPLE_ROWS):
    """Rows (row, rejected_by) for every row of ``df``; ``rejected_by`` is null for rows that all rules pass.

    Which rule is named for a row that several reject depends on the measured order; whether one is does not. Null and
    empty texts have no words and are short. Lines that differ in white space differ; lines without a word do not
    count. Columns of any name stay inside ``row``; repeated rows are judged each; an empty table gives an empty result.
    """
    ordered = [inlined(rule) for rule, _, _ in measured(df, text, rules, sample_rows)]
    return with_words(df, text).select("row", cascade(ordered).alias("rejected_by"))


def quality_report(df, key="doc_id", text="text"):
    """Base metrics of every row, whether it fails the base rules, and whether it is kept.

    Rows that fail the base are not judged further; the others go through the cascade of the method's own rules, whose
    metrics are computed rule by rule. Null and empty texts fail. Repeated rows are judged each; an empty table gives an
    empty result; columns beside the two named are not looked at.
    """
    narrow = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    ordered = [inlined(rule, REPORTED) for rule, _, _ in measured(narrow, "text", OWN_RULES, known=REPORTED)]
    base = [F.expr(rule.rejects) for rule in BASE_RULES]
    judged = with_metrics(with_words(narrow, "text"), REPORTED).withColumn("base_failed", base[0] | base[1])
    passed = cascade([Rule("base", "base_failed"), *ordered]).isNull()
    return judged.select(F.col("row.key").alias(key), *REPORTED, "base_failed", passed.alias("kept"))
