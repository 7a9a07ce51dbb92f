"""Text folding and similarity as column expressions."""

from __future__ import annotations

import json
import re
import string
import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def _foldings() -> tuple[str, str, dict[str, str]]:
    """Letters and what each is folded to, marks (deleted) last, and characters that become several, from Unicode's compatibility
    decompositions without combining marks (U+0300 to U+036F). What has no letter or digit of ASCII in it isn't listed."""
    one, several = {}, {}
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000))):
        apart = unicodedata.normalize("NFKD", c)
        bare = re.sub("[\u0300-\u036f]", "", apart).lower()
        if bare != c and re.search("[a-z0-9']", bare):
            if len(bare) == 1:
                one[c] = bare
            else:
                several[c] = bare
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(one) + marks, "".join(one.values()), several


LETTERS, PLAIN, SEVERAL = _foldings()
#: Letters and digits, each by itself: Java looks such a class up in a table, ranges in a union of predicates for each character.
ALNUM = string.ascii_lowercase + string.digits


def _ranges(chars: Iterable[str]) -> str:
    """A pattern's class of characters, in runs."""
    out: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out) + "]"


def folded(x: Column) -> Column:
    """Lower case, letters without marks, compatibility forms (ligatures, wide letters, numbers in circles) spelled out."""
    table = F.from_json(F.lit(json.dumps(SEVERAL)), "map<string, string>")  # one constant, not a node of the plan for each entry
    spelled = F.array_join(F.transform(F.split(x, ""), lambda c: F.coalesce(table[c], c)), "")
    wide = F.translate(F.when(x.rlike(_ranges(SEVERAL)), spelled).otherwise(x), LETTERS, PLAIN)
    return F.lower(F.when(F.octet_length(x) != F.length(x), wide).otherwise(x))


def normalized(x: Column) -> Column:
    """Lower case without marks; letters, digits, apostrophes and single spaces remain."""
    return F.trim(F.regexp_replace(folded(x), f"[^{ALNUM}']+", " "))


def squeezed(x: Column) -> Column:
    """As ``normalized``, without apostrophes."""
    return F.trim(F.regexp_replace(folded(x), f"[^{ALNUM}]+", " "))


def title(x: Column) -> Column:
    return F.initcap(F.lower(F.trim(x)))


def label(x: Column) -> Column:
    """Single spaces, first letter upper."""
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.concat(F.upper(F.substring(one, 1, 1)), F.substring(one, 2, 1_000_000))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def _tokens(x: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(x, " ")), "")


def token_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of words; 0 if either has none."""
    x, y = _tokens(a), _tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def similarity(a: Column, b: Column, t: Column | None = None) -> Column:
    """Name similarity of normalised texts: 0.55 edits, 0.33 words, 0.12 for containment, 0.08 for any shared word.

    ``t``, their token similarity, may be a column that is worked out already."""
    t = token_similarity(a, b) if t is None else t
    inside = F.when(F.contains(a, b) | F.contains(b, a), 0.12).otherwise(0.0)
    mixed = F.least(F.lit(1.0), 0.55 * edit_similarity(a, b) + 0.33 * t + inside + F.when(t > 0, 0.08).otherwise(0.0))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def spread(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs of names over all shuffle partitions: they are few bytes, but each takes long to compare."""
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def r4(x: Column) -> Column:
    """Four decimals, halves up."""
    return F.floor(x * 1e4 + 0.5) / 1e4
