"""Format-preserving pseudonyms for personal data in texts, in DataFrame functions only.

One pattern finds candidates; each is validated and then replaced inside its own format:

* payment cards (13 to 19 digits, Luhn sum right): the digits but the last are permuted, the last
  is computed anew; blanks and hyphens stay where they are. In a longer row of numbers every part that begins and ends at a blank or
  hyphen is tried, long ones before short ones, from the left;
* IBANs (remainder 1 modulo 97), printed whole or in groups of four with the length of their country:
  the account's digits are permuted, the check digits computed anew;
* social security numbers (no impossible area, group or serial): permuted among the valid ones;
* telephone numbers, also international ones with a plus sign: the last ten digits are permuted (all but the first of a
  number with a plus sign and fewer), a country code and all punctuation stay;
* IPv4 addresses (each part at most 255): permuted among all addresses;
* dates of 1800 to 2199 (that exist), as y-m-d, d.m.y or m/d/y: permuted among the 146,097 days of
  those 400 years;
* e-mail addresses: 128 bits of a keyed digest, so different addresses don't meet;
* hexadecimal secrets of 32 digits and more in either case, access keys of 20 capitals and digits, what follows "bearer" (16
  characters and more), and what is assigned to a word such as "password", "secret_key" or "token", in any case, with an equals
  sign or colon, with or without blanks (up to eight on either side) and quotes: a keyed digest of the same length. A value ends before
  a blank or quote, and before punctuation at its end. What is assigned so and looks like another kind, but isn't a valid one, is a secret.

The permutations are alternating Feistel networks whose round function is a keyed SHA-256; their two
halves are residues modulo numbers whose product is the size of the format, so nothing needs a
second try and no two values meet. A value's pseudonym depends on the key, the kind and the value
alone: equal values stay linked across documents, in whatever punctuation they are written.
Other candidates that are not valid stay as they are, and so does all other text.

A null text stays null with no replacements, an empty one empty. Repeated rows get equal results.
Other columns are kept, whatever their names; the operator adds ``n_replaced``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Countries by the length of their IBANs.
IBANS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV", 22: "BG|BH|CR|DE|GB|GE|IE|ME|RS",
    23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|SM",
    28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _grouped(length: int) -> str:
    """The part of an IBAN of ``length`` behind its check digits, in groups of four."""
    whole, rest = divmod(length - 4, 4)
    return f"(?: [A-Z0-9]{{4}}){{{whole}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")


GROUPED = "|".join(f"(?:{countries})[0-9]{{2}}{_grouped(n)}" for n, countries in IBANS.items())
#: What stands between a word such as "token" and its value.
SIGN = r"[ \t]{0,8}[:=][ \t]{0,8}[\"']?"
ASSIGNS = rf"(?i:password|passwd|pwd|secret|token|(?:api|secret|access|private)[_-]?key)[\"']?{SIGN}"
BEARER = "(?i:bearer) "
#: What each kind looks like, in the order in which a place is tried.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}(?![\p{L}\p{N}])",
    # Whole values come before kinds that they may only begin like. The first two conditions are cheap and rule out nearly all places.
    "assigned": rf"(?<=[:= \t\"'])(?:(?<={SIGN})(?<={ASSIGNS})[^\s\"']{{5,}}[^\s\"'.,;:!?)\]}}]|(?<={BEARER})[A-Za-z0-9_.~+/=-]{{15,}}[A-Za-z0-9_~+/=-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9A-Fa-f]{32,}+|A[KS]IA[0-9A-Z]{16})(?![A-Za-z0-9])",
    "iban": rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|(?=[A-Z]{{2}}[0-9]{{2}} )(?:{GROUPED}))(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![./-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9+])(?:(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|(?<=[ .-])[0-9]{3}[ .-]|(?<![0-9+ .-])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .-]?[0-9]){7,14})(?!-?[0-9])",
    # A row of numbers that a card may be part of; it ends before a date or social security number of its own.
    "card": r"(?<![0-9])[0-9](?:[0-9]|[ -](?![0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))[0-9]){12,199}+",
}
ANY = "|".join(KINDS.values())


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), *parts), 256)


def _number(hexadecimal: Column) -> Column:
    """The first 15 hexadecimal digits as a number."""
    return F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """A struct of ``left`` and ``right``, permuted within 0..size-1 each."""

    def step(state: Column, n: Column) -> Column:
        a, b = state["left"], state["right"]
        noise = _number(_keyed(key, kind, n.cast("string"), left_size.cast("string"), right_size.cast("string"), F.when(n % 2 == 0, b).otherwise(a).cast("string")))
        return F.struct(
            F.when(n % 2 == 0, (a + noise % left_size) % left_size).otherwise(a).alias("left"),
            F.when(n % 2 == 1, (b + noise % right_size) % right_size).otherwise(b).alias("right"),
        )

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of 2 to 36 digits, permuted among those of its length."""
    half = F.ceil(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    left, right = F.left(digits, half).cast("long"), F.right(digits, rest).cast("long")
    done = feistel(left, right, _power(half), _power(rest), key, kind)
    return F.concat(F.lpad(done["left"].cast("string"), half, F.lit("0")), F.lpad(done["right"].cast("string"), rest, F.lit("0")))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn by ``digits``."""
    chars = F.split(value, "")
    place = lambda i: F.length(_digits(F.substring(value, F.lit(1), i + 1)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum from the right; every second digit is doubled, from place ``doubled`` (0 or 1) on."""
    back = F.split(F.reverse(digits), "")
    terms = F.transform(back, lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _one_card(value: Column, key: str) -> Column:
    digits = _digits(value)
    body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
    return _laid_out(value, F.concat(body, ((F.lit(10) - _luhn_sum(body, 0) % 10) % 10).cast("string")))


def _card(value: Column, key: str) -> Column:
    """A struct of ``new``, a row of numbers with its valid cards replaced, and their number ``n``."""
    parts = F.split(value, "(?<=[ -])")  # each with what separates it from the next
    bound = F.struct(parts.alias("parts"), F.transform(parts, lambda p: F.regexp_replace(p, "[ -]$", "")).alias("numbers"))
    return F.transform(F.array(bound), lambda row: _cards_in(row["parts"], row["numbers"], key))[0]


def _cards_in(parts: Column, numbers: Column, key: str) -> Column:
    n = F.size(parts)

    def digits(at: Column, size: Column) -> Column:
        return F.array_join(F.slice(numbers, at, size), "")

    def longest(at: Column) -> Column:
        """How many parts the longest valid card has that begins at ``at``; 0 if there is none."""
        sizes = F.filter(F.sequence(F.lit(1), F.least(n - at + 1, F.lit(19))), lambda k: F.length(digits(at, k)).between(13, 19))
        return F.coalesce(F.array_max(F.filter(sizes, lambda k: _luhn_sum(digits(at, k), 1) % 10 == 0)), F.lit(0))

    def replaced(at: Column, size: Column) -> Column:
        """The parts of a card; the last keeps what separates it."""
        run = F.array_join(F.slice(parts, at, size - 1), "")
        last = at + size - 2
        card = F.transform(F.array(F.concat(run, numbers[last])), lambda v: _one_card(v, key))[0]
        return F.concat(card, F.substring(parts[last], F.length(numbers[last]) + 1, F.lit(1)))

    def step(state: Column, at: Column) -> Column:
        size = F.struct(F.when(at < state["next"], 0).otherwise(longest(at)).alias("size"))
        after = lambda x: F.struct(F.concat(state["new"], replaced(at, x["size"])).alias("new"), (state["n"] + 1).alias("n"), (at + x["size"]).alias("next"))
        plain = F.struct(F.concat(state["new"], parts[at - 1]).alias("new"), state["n"].alias("n"), state["next"].alias("next"))
        return F.transform(F.array(size), lambda x: F.when(x["size"] > 0, after(x)).when(at < state["next"], state).otherwise(plain))[0]

    start = F.struct(F.lit("").alias("new"), F.lit(0).alias("n"), F.lit(1).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda state: F.struct(state["new"].alias("new"), state["n"].alias("n")))


def _remainder_97(value: Column) -> Column:
    moved = F.concat(F.substring(value, F.lit(5), F.length(value) - 4), F.left(value, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + letter) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step)


def _iban(printed: Column, key: str) -> Column:
    value = F.replace(printed, F.lit(" "), F.lit(""))
    account = F.substring(value, F.lit(5), F.length(value) - 4)
    digits = _digits(account)
    own = F.when(F.length(digits) >= 2, _laid_out(account, permuted_digits(digits, key, "iban"))).otherwise(account)
    check = F.lit(98) - _remainder_97(F.concat(F.left(value, F.lit(2)), F.lit("00"), own))
    whole = F.concat(F.left(value, F.lit(2)), F.lpad(check.cast("string"), 2, "0"), own)
    return F.when(_remainder_97(value) == 1, _laid_out(printed, _digits(whole))).otherwise(printed)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    done = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    new_area = done["left"] + F.when(done["left"] >= 665, 2).otherwise(1)
    new = F.format_string("%03d-%02d-%04d", new_area, F.floor(done["right"] / 9999) + 1, done["right"] % 9999 + 1)
    return F.when(valid, new).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    digits = _digits(value)
    kept = F.greatest(F.length(digits) - 10, F.when(value.startswith("+"), 1).otherwise(0))
    own = permuted_digits(F.substring(digits, kept + 1, F.length(digits) - kept), key, "phone")
    return _laid_out(value, F.concat(F.left(digits, kept), own))


def _ip(value: Column, key: str) -> Column:
    part = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    done = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, "ip")
    return F.format_string("%d.%d.%d.%d", F.floor(done["left"] / 256), done["left"] % 256, F.floor(done["right"] / 256), done["right"] % 256)


def _date(value: Column, key: str) -> Column:
    pattern = F.when(value.contains("-"), "yyyy-MM-dd").when(value.contains("."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    part = F.split(value, "[./-]")
    y, m, d = (F.when(value.contains("-"), part[a]).when(value.contains("."), part[b]).otherwise(part[c]) for a, b, c in ((0, 2, 2), (1, 1, 0), (2, 0, 1)))
    date = F.concat_ws("-", y, m, d).try_cast("date")
    day = F.unix_date(date).cast("long") + 62091  # days from 1800-01-01
    done = feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, "date")
    new = F.date_format(F.date_from_unix_date((done["left"] * 773 + done["right"] - 62091).cast("int")), "yyyy-MM-dd")
    own = F.when(pattern == "yyyy-MM-dd", new).when(pattern == "dd.MM.yyyy", F.concat_ws(".", F.substring(new, 9, 2), F.substring(new, 6, 2), F.substring(new, 1, 4)))
    short = lambda at, was: F.when(F.length(was) == 2, F.substring(new, at, 2)).otherwise(F.substring(new, at, 2).cast("int").cast("string"))
    own = own.otherwise(F.concat_ws("/", short(6, part[0]), short(9, part[1]), F.substring(new, 1, 4)))
    return F.when((day >= 0) & (day < 146097), own).otherwise(value)


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.left(_keyed(key, "email", F.lower(value)), F.lit(32)), F.lit("@masked.invalid"))


def _secret(value: Column, key: str) -> Column:
    # Hexadecimal secrets are equal in either case, other values are not.
    hexadecimal = value.rlike("^[0-9A-Fa-f]{32,}$")
    own = F.when(hexadecimal, F.lower(value)).otherwise(value)
    blocks = F.sequence(F.lit(0), F.floor((F.length(value) - 1) / 64).cast("int"))
    digests = F.transform(blocks, lambda n: F.sha2(F.concat_ws(":", F.lit(key), F.concat(F.lit("secret"), n.cast("string")), own), 256))
    digest = F.left(F.array_join(digests, ""), F.length(value))
    return F.when(hexadecimal & value.rlike("[A-F]") & ~value.rlike("[a-f]"), F.upper(digest)).otherwise(digest)


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, assigned: Column, key: str) -> Column:
    """A struct of ``new``, the pseudonym of one found value or the value where it is not valid, and ``n``, how many values were replaced in it.

    ``assigned``: whether it stands behind a word such as "token" and a sign.
    """
    once = lambda new: F.struct(new.alias("new"), (new != value).cast("int").alias("n"))
    out = F.when(F.lit(False), once(value))
    for kind, pattern in KINDS.items():
        if kind == "assigned":
            continue
        bare = pattern.split(")", 1)[1]  # without what stands before
        shape = {
            "phone": r"(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[1-9](?:[ .-]?[0-9]){7,14}",
            "card": r"[0-9](?:[ -]?[0-9]){12,199}",
        }.get(kind, bare)
        made = MAKERS[kind](value, key)
        out = out.when(value.rlike(f"^(?:{shape})$"), made if kind == "card" else F.transform(F.array(made), once)[0])
    found = out.otherwise(once(value))
    return F.transform(F.array(found), lambda x: F.when(assigned & (x["n"] == 0), once(_secret(value, key))).otherwise(x))[0]


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_replaced") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col`` and the number of replacements in ``count_col``."""
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    around = F.split(text, ANY)
    # Names that no column of the table has. The lists are columns of their own, so that each is computed once.
    lists, new, count = (("_" * (max(map(len, docs.columns), default=0) + 1)) + n for n in ("lists", "new", "count"))
    listed = docs.select("*", F.when(text.rlike(ANY), F.struct(found.alias("found"), around.alias("around"))).alias(lists))
    of = lambda part: F.col(lists)[part]
    behind = lambda i: F.right(F.element_at(of("around"), i + 1), F.lit(40)).rlike(f"(?:{ASSIGNS}|{BEARER})$")
    made = listed.withColumn(new, F.transform(of("found"), lambda v, i: pseudonym(v, behind(i), key)))
    pieces = F.zip_with(of("around"), F.col(new), lambda a, v: F.concat(a, F.coalesce(v["new"], F.lit(""))))
    changed = F.aggregate(F.col(new), F.lit(0), lambda total, v: total + v["n"])
    counted = F.when(F.col(lists).isNull(), 0).otherwise(changed).cast("long")
    replaced = F.when(F.col(lists).isNull(), text).otherwise(F.array_join(pieces, ""))
    columns = [replaced.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return made.select(*columns, counted.alias(count_col))
