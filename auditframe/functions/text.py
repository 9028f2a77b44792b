"""Scalar functions on sequences, hashes, JSON and sets, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 20 standard residues in the order of the feature layout (fixed values).
LETTERS = "ACDEFGHIKLMNPQRSTVWY"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def as_sequence(text: Column) -> Column:
    """The letters A-Z of a text, upper-cased."""
    return F.regexp_replace(F.translate(text, LOWER, UPPER), "[^A-Z]", "")


def letter_fraction(sequence: Column, letter: str) -> Column:
    n = F.length(sequence)
    return F.when(n > 0, (n - F.length(F.replace(sequence, F.lit(letter), F.lit("")))) / n).otherwise(0.0)


def entropy(fractions: list[Column]) -> Column:
    """Shannon entropy in nats over positive fractions."""
    return sum((F.when(p > 0, -p * F.ln(p)).otherwise(0.0) for p in fractions), F.lit(0.0))


def grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams in the order of their first places; none of a text shorter than ``n``.

    Each match takes one character and looks ahead at the gram that begins with it.
    """
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({'.' * n}))."), F.lit(1)))


def json_list(text: Column, kind: str = "array<string>") -> Column:
    """A JSON list; anything malformed is an empty list."""
    return F.coalesce(F.from_json(text, kind, {"mode": "PERMISSIVE"}), F.array().cast(kind))


def first_usable(records: Column, field: str) -> Column:
    """The first value of a field that isn't null, empty or "unknown"."""
    values = F.transform(records, lambda r: r[field].cast("string"))
    return F.try_element_at(F.filter(values, lambda v: v.isNotNull() & (v != "") & (F.lower(v) != "unknown")), F.lit(1))


def set_delta(a: Column, b: Column) -> Column:
    """Gained, lost and Jaccard similarity of two sets; two empty sets are alike."""
    union = F.size(F.array_union(a, b))
    return F.struct(
        F.size(F.array_except(b, a)).alias("gained"),
        F.size(F.array_except(a, b)).alias("lost"),
        F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.when(union > 0, union)).alias("jaccard"),
    )


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first eight hexadecimal digits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / 2**32


def binned(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-closed bins between ``edges``, open at both ends; one label more than edges."""
    out = F.when(value.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(value < edge, label)
    return out.otherwise(labels[len(edges)])


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def general8(value: Column) -> Column:
    """A number with eight significant digits and no trailing zeros; null for null.

    For zero and magnitudes from 0.0001 to just below 100,000,000, which need no exponent.
    """
    size = F.abs(value)
    out = F.when(size == 0, "0")
    for exponent in range(-4, 8):
        fixed = F.format_string(f"%.{7 - exponent}f", value)
        whole = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
        out = out.when(size < 10.0 ** (exponent + 1) * (1 - 5e-9), whole)
    return out


def padded_length(length: Column, multiple: int = 16) -> Column:
    """The length rounded up to a multiple."""
    return (F.ceil(length / multiple) * multiple).cast("long")


def residues(sequence: Column) -> Column:
    """Selenocysteine read as unknown."""
    return F.translate(sequence, "U", "X")


def ineligible(sequence: Column, longest: int = 1022) -> Column:
    """Why a sequence can't be represented; null if it can."""
    n = F.length(sequence)
    return F.when(sequence.isNull() | (n == 0), "empty").when(n > longest, "too long").when(sequence.rlike("[^A-Z]"), "not a sequence")


def channel(letter: Column) -> Column:
    """Number of a letter's channel; all but the 20 letters share the last, number 20."""
    place = F.instr(F.lit(LETTERS), letter)
    return F.when(place > 0, place - 1).otherwise(len(LETTERS)).cast("long")


def canonical_json(**fields: Column) -> Column:
    """Compact JSON of fields in the order of their names. Strings are quoted as JSON does."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def counts_json(pairs: Column) -> Column:
    """A JSON object from an array of (name, number), in the order of names."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(F.lit('"'), p["name"], F.lit('":'), p["n"].cast("string"))), ","), F.lit("}"))


def digest_seed(digest: Column, little: bool = False) -> Column:
    """The first eight bytes of a hexadecimal digest as an unsigned number, in decimal."""
    first = F.substring(digest, 1, 16)
    if little:
        first = F.array_join(F.transform(F.sequence(F.lit(15), F.lit(1), F.lit(-2)), lambda i: F.substring(first, i, F.lit(2))), "")
    return F.conv(first, 16, 10)


def structure_id(name: Column) -> Column:
    """Code and ordered chain candidates of an id such as "1abc_B2": the chain as written, without its
    trailing digits, and its first letter, each once."""
    chain = F.split_part(name, F.lit("_"), F.lit(2))
    candidates = F.array(chain, F.regexp_replace(chain, "[0-9]+$", ""), F.substring(chain, 1, 1))
    return F.struct(F.lower(F.split_part(name, F.lit("_"), F.lit(1))).alias("code"), F.array_distinct(F.filter(candidates, lambda c: c != "")).alias("chains"))


def alignment_records(text: Column) -> Column:
    """Query sequence and depth of a FASTA or A3M text: records begin with ">"; lower-case insertions go."""
    records = F.filter(F.split(text, "(?:^|\n)>"), lambda r: F.trim(r) != "")
    bodies = F.transform(records, lambda r: F.regexp_replace(F.regexp_replace(r, r"^[^\n]*", ""), r"[a-z\s]", ""))
    return F.struct(F.try_element_at(bodies, F.lit(1)).alias("query"), F.size(F.filter(bodies, lambda b: b != "")).cast("long").alias("depth"))


def query_kind(query: Column) -> Column:
    """What a query names: an accession, a sequence of ten letters or more, nothing, or a name."""
    return F.when(query == "", "empty").when(query.rlike("^[OPQ][0-9][A-Z0-9]{3}[0-9]$"), "accession").when(query.rlike("^[A-Z]{10,}$"), "sequence").otherwise("name")


def query_id(query: Column) -> Column:
    """The accession, or an id from a sequence's digest; null for what must be looked up."""
    kind = query_kind(query)
    return F.when(kind == "accession", query).when(kind == "sequence", F.concat(F.lit("sequence_"), F.substring(F.sha2(query, 256), 1, 12)))
