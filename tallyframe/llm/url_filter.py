"""URL filter: host and path rules first, then a weighted vocabulary.

One Aho-Corasick automaton holds all forms of all terms. A form counts where no letter or digit touches it, also when
it is written in percent signs, and the forms of a term count as one. One strict term rejects an address, and so do two
different soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Terms that reject an address alone, and terms of which it takes two.
STRICT = "adult casino escort hentai malware phishing porn porno pills sex spam viagra warez xxx".split()
SOFT = (
    "ad/ads bet/bets bonus cheap click/clicks coupon deals download farm free gamble hot keygen loan/loans poker popup "
    "promo replica slots track/tracker/tracking win/winner"
).split()
# The rules of the contract, as (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# A vocabulary travels with every task.
MAX_FORMS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Terms by their forms, and weights; an address whose different terms weigh ``reject_at`` or more is blocked.

    ``forms`` maps each form, in lower case, to its term and weight.
    """

    forms: dict[str, tuple[str, int]] = field(
        default_factory=lambda: {
            form: (term.split("/")[0], weight)
            for terms, weight in ((SOFT, 1), (STRICT, 2))
            for term in terms
            for form in term.split("/")
        }
    )
    reject_at: int = 2

    @classmethod
    def read(cls, terms: DataFrame, reject_at: int = 2, max_forms: int = MAX_FORMS) -> Vocabulary:
        """A vocabulary from a table ``form``, ``term`` (null: the form itself), ``weight``.

        Forms are lower-cased in A-Z; null and empty ones are left out. Of rows that repeat a form the greatest weight
        counts, of equal ones the first term. A table of more than ``max_forms`` forms is refused.
        """
        form = F.translate(F.col("form"), UPPER, LOWER)
        best = F.max_by(F.struct("term", "weight"), F.struct("weight", F.lit(0))).alias("best")
        rows = terms.select(form.alias("form"), F.coalesce("term", form).alias("term"), F.col("weight").cast("int").alias("weight"))
        rows = rows.where("form <> '' AND weight IS NOT NULL").groupBy("form", "weight").agg(F.min("term").alias("term"))
        found = rows.groupBy("form").agg(best).limit(max_forms + 1).collect()
        if len(found) > max_forms:
            raise ValueError(f"more than {max_forms} forms")
        return cls({r.form: (r.best.term, r.best.weight) for r in found}, reject_at)

    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for form, (term, weight) in self.forms.items():
            made.add_word(form, (len(form), term, weight))
        made.make_automaton()
        return made


_LOWERED = str.maketrans(UPPER, LOWER)


def readable(address: str) -> str:
    """The address as it is matched: percent signs decoded, A-Z in lower case."""
    return (unquote(address) if "%" in address else address).translate(_LOWERED)


def terms_in(automaton: ahocorasick.Automaton, text: str) -> dict[str, int]:
    """The different terms of ``text`` with their weights; a form must stand alone."""
    found: dict[str, int] = {}
    if not len(automaton):
        return found
    for end, (length, term, weight) in automaton.iter(text):
        start = end - length + 1
        if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            found[term] = max(weight, found.get(term, weight))
    return found


def matching_rule(rules: dict[str, list[tuple[str, str, str]]], host: str, path: str) -> tuple[str, str] | None:
    """The longest rule, with its action, whose host is ``host`` or a parent and whose path begins ``path``."""
    best = None
    labels = host.split(".")
    for i in range(len(labels)):
        for prefix, action, rule in rules.get(".".join(labels[i:]), ()):
            if path.startswith(prefix) and (best is None or len(rule) > len(best[0])):
                best = (rule, action)
    return best


def url_filter(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: tuple[tuple[str, str], ...] = RULES,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``terms`` (comma-joined).

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the
    path goes from there to ``?``, ``#`` or the end. A null address, or one without ``://``, has an empty host
    and path. The longest fitting rule decides (of equally long ones the first); without one the vocabulary is
    looked up in the whole address, its percent signs decoded and A-Z in lower case. A null address has no terms and is allowed. Repeated
    rows are judged alike; an empty table gives an empty result; other columns are not read.
    """
    words = vocabulary or Vocabulary()
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host, []).append((slash + path, action, rule))

    url = F.col(url_col).cast("string")
    after = F.when(F.instr(url, "://") > 0, F.expr(f"substr(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    rows = pages.select(
        F.col(id_col).alias("id"), url.alias("url"), F.coalesce(after, F.lit("")).alias("rest")
    ).select(
        "id",
        F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
        "url",
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = words.automaton()
        for batch in batches:
            rule_of, verdict, terms = [], [], []
            for host, path, address in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = terms_in(automaton, readable(address or ""))
                fit = matching_rule(by_host, host, path)
                by_words = "block" if sum(found.values()) >= words.reject_at else "allow"
                rule_of.append(fit and fit[0])
                verdict.append(fit[1] if fit else by_words)
                terms.append(",".join(sorted(found)))
            columns = [pa.array(rule_of, pa.string()), pa.array(verdict, pa.string()), pa.array(terms, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["id", "host", "path", "rule", "verdict", "terms"])

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, terms string")
    return out.withColumnRenamed("id", id_col)
