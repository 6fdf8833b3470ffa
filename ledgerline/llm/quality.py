"""Quality rules as a short-circuit cascade, ordered by what each rule rejects for its cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, words_of

_symbols = re.compile(r"[#*$%&|<>]").findall
#: Documents whose rules are timed; the order of rules depends on them, the verdicts don't.
SAMPLE_ROWS = 400
WINDOW = 5


class Features:
    """What rules ask of a text; each is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return words_of(self.text)

    @cached_property
    def n_symbols(self) -> int:
        return len(_symbols(self.text))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\r\x0b\x0c")]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(*(w[i:] for i in range(WINDOW)), strict=False))
        if len(set(grams)) == len(grams):
            return 0
        often, total, end = Counter(grams), 0, 0
        for i, gram in enumerate(grams):
            if often[gram] > 1:
                total += i + WINDOW - max(i, end)
                end = i + WINDOW
        return total

    @cached_property
    def letters(self) -> int:
        return sum(map(str.isalpha, self.text))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: Ratios are far from those of ordinary prose, so that clean documents stay.
RULES = (
    Rule("symbols", lambda x: 10 * x.n_symbols > len(x.words)),
    Rule("duplicate lines", lambda x: 2 * x.n_dup_lines > len(x.lines)),
    Rule("stutter", lambda x: 10 * sum(map(str.__eq__, x.words, x.words[1:])) > 3 * len(x.words)),
    Rule("capitals", lambda x: 2 * sum(map(str.isupper, x.text)) > max(x.letters, 1)),
    Rule("few letters", lambda x: 10 * x.letters < 3 * sum(map(len, x.words))),
    Rule("word length", lambda x: not 2 * len(x.words) <= sum(map(len, x.words)) <= 15 * len(x.words)),
    Rule("one word", lambda x: bool(x.words) and 2 * max(Counter(x.words).values()) > len(x.words)),
)


def base_failed(x: Features) -> bool:
    return len(x.words) < 10 or 100 * x.n_repeat_words > 20 * len(x.words)


def cascade_order(texts: Iterable[str | None], rules: tuple[Rule, ...] = RULES, clock: Callable[[], float] = time.perf_counter) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, cost) in the order to run them.

    Each next rule is the one that rejects most of the texts still left for its cost, which is what it takes once the base counts are there. A rule that rejects nothing left costs without gain and goes last, cheap ones first.
    """
    texts = list(texts)
    cost, hit = {}, {}
    for rule in rules:
        ready = [Features(text) for text in texts]
        for x in ready:
            _ = x.words, x.n_symbols, x.n_dup_lines, x.n_repeat_words
        began = clock()
        seen = [rule.rejects(x) for x in ready]
        cost[rule.name] = max(clock() - began, 1e-9) / max(len(texts), 1)
        hit[rule.name] = {i for i, x in enumerate(seen) if x}
    order, left, rest = [], set(range(len(texts))), list(rules)
    while rest:
        best = max(rest, key=lambda r: (len(hit[r.name] & left) / cost[r.name], -cost[r.name]))
        order.append((best, len(hit[best.name] & left) / max(len(left), 1), cost[best.name]))
        left -= hit[best.name]
        rest.remove(best)
    return order


def fit(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules in cascade order, timed on at most ``sample_rows`` rows, those of the least hashes of the whole table. A rule's verdict doesn't depend on the others."""
    sample = docs.select(F.col(text_col).alias("text")).orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    reach = (row.text for row in sample.toLocalIterator() if not base_failed(Features(row.text)))  # only these get to the rules
    return tuple(r for r, _, _ in cascade_order(reach, rules))


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def score(docs: DataFrame, rules: tuple[Rule, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id with base counts and the verdict: the base test, then rules until one rejects.

    A row a document, repeated rows too. Null and empty texts have no words and fail the base test.
    rejected_by is ``base`` or the first rule that rejects; it depends on the order of rules, the verdict does not.
    Empty table: no rows. Extra columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                x = Features(text)
                failed = base_failed(x)
                by = "base" if failed else next((rule.name for rule in rules if rule.rejects(x)), None)
                out.append((len(x.words), sum(map(len, x.words)), x.n_symbols, x.n_dup_lines, x.n_repeat_words, failed, by is None, by))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
            frame.insert(0, "id", batch["id"].to_numpy())
            yield frame

    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(rows, f"id {kind}, {OUT}").withColumnRenamed("id", id_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs)).drop("rejected_by")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
spots AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w),
grams AS (SELECT r, i, words[i:i+4] AS g FROM spots),
twice AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
rep AS (SELECT r, sum(least(5, coalesce(gap, 5))) AS n FROM
        (SELECT r, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS gap FROM twice) GROUP BY r),
m AS (SELECT w.*, len(words)::BIGINT AS n, coalesce(rep.n, 0)::BIGINT AS n_rep, list_sum(list_transform(words, lambda x: length(x)))::BIGINT AS chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS sym, len(lines) - len(list_distinct(lines)) AS dup,
        length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS upper_letters,
        len(list_filter(range(2, len(words) + 1), lambda k: words[k] = words[k-1])) AS stutter,
        list_max(map_values(list_aggregate(words, 'histogram'))) AS most
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n < 10 OR 100 * n_rep > 20 * n AS failed FROM m)
SELECT doc_id, n AS n_words, coalesce(chars, 0) AS word_chars, sym::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, n_rep AS n_repeat_words,
       failed AS base_failed,
       NOT failed AND NOT (10 * sym > n OR 2 * dup > len(lines) OR 10 * stutter > 3 * n OR 2 * upper_letters > greatest(letters, 1)
         OR 10 * letters < 3 * chars OR chars < 2 * n OR chars > 15 * n OR 2 * most > n) AS kept
FROM b
"""
