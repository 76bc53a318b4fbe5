"""PII (5): format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are permuted by keyed Feistel networks inside their own format, so equal
values get equal pseudonyms in all documents, different values different ones, and the key
holder can turn them back (``restore``).  No table of values is kept or moved: every row is
worked on by itself, without a shuffle.

Kinds, found leftmost and non-overlapping in this order of preference:
  email  local@host.tld: letters and digits of the local part are permuted, the host stays
  card   13 to 19 digits, in one piece or in fours, with a right check digit: the digits before it are
         permuted and the check digit is computed anew
  phone  +cc and 8 to 13 digits with common separators: the digits after the country code are permuted
  ip     four numbers up to 255, in a permutation of all addresses
  ssn    ddd-dd-dddd with valid parts, in a permutation of all valid numbers
  date   yyyy-mm-dd of the years 1800 to 2199, in a permutation of those days
A value that does not validate stays as it is.

Pseudonyms of cards and phones depend on their digits alone, which are laid back into the
format: a number has one pseudonym however it is grouped.  The country code is told by the digits, too.

Two networks of ``ROUNDS`` rounds, with keyed SHA-256 as round function:
* of numbers: x = l * B + r; in turn l += f(r) mod A and r += f(l) mod B, a permutation of A * B numbers;
* of strings: the same on the two halves of a string, where every letter or digit moves inside its
  own class (0-9, a-z, A-Z) and other characters stay.

Defined results.  Null text stays null, empty text empty, with counts of 0.  Other columns,
null and repeated ids included, are left alone.  Empty table: empty result.  Input columns
named like an output count give way to it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.tables import table

# a stand-in; give ``pseudonymise`` a secret key
KEY = "pseudonym-key-1"
ROUNDS = 8
KINDS = ("email", "card", "phone", "ip", "ssn", "date")

# fixed values: the international country codes, which no other one begins with; all others have three digits
COUNTRY_CODE = "[17]|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|[0-9]{3}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: the formats.  Each starts where no longer run of its characters can
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9-])(?:18|19|20|21)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
# every match of ANY holds an @, or digits and separators from digit to digit, seven or more
HINT = "@|[0-9][0-9 .()-]{5,}[0-9]"
COUNTS = [f"n_{k}" for k in KINDS]
# 400 Gregorian years always have this many days
FIRST_DAY, DAYS = "1800-01-01", 146097


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """The round function: a number below 2**48."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def _rounds(reverse: bool) -> Column:
    return F.array(*[F.lit(i) for i in (range(ROUNDS - 1, -1, -1) if reverse else range(ROUNDS))])


def permute_number(left: Column, right: Column, a: int, b: int, key: str, kind: str, reverse: bool = False) -> Column:
    """struct(l, r): a permutation of the pairs l < a, r < b."""
    sign = -1 if reverse else 1
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(s, i):
        even = i % 2 == 0
        move = _keyed(key, kind, i, F.when(even, s["r"]).otherwise(s["l"]))
        return F.struct(F.when(even, F.pmod(s["l"] + sign * (move % a), F.lit(a))).otherwise(s["l"]).cast("bigint").alias("l"),
                        F.when(even, s["r"]).otherwise(F.pmod(s["r"] + sign * (move % b), F.lit(b))).cast("bigint").alias("r"))

    return F.aggregate(_rounds(reverse), start, step)


def _moved(half: Column, other: Column, i: Column, key: str, kind: str, sign: int) -> Column:
    """Each letter or digit of ``half`` moved in its class by keyed numbers of the other half."""
    def one(c, j):
        code, move = F.ascii(c), _keyed(key, kind, i, j, F.char_length(half), other)
        inside = lambda base, size: F.char(base + F.pmod(code - base + sign * (move % size), F.lit(size)))      # noqa: E731
        return (F.when(c.rlike("^[0-9]$"), inside(48, 10)).when(c.rlike("^[a-z]$"), inside(97, 26))
                .when(c.rlike("^[A-Z]$"), inside(65, 26)).otherwise(c))

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permute_string(value: Column, key: str, kind: str, reverse: bool = False) -> Column:
    """A permutation of the strings with the same character classes in the same places."""
    sign = -1 if reverse else 1
    cut = F.floor(F.char_length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"),
                     F.substring(value, cut + 1, F.char_length(value)).alias("r"))

    def step(s, i):
        even = i % 2 == 0
        return F.struct(F.when(even, _moved(s["l"], s["r"], i, key, kind, sign)).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(_moved(s["r"], s["l"], i, key, kind, sign)).alias("r"))

    return F.aggregate(_rounds(reverse), start, step, lambda s: F.concat(s["l"], s["r"]))


def check_digit(body: Column) -> Column:
    """The Luhn digit that follows the digits of ``body`` (separators are skipped)."""
    digits = F.reverse(F.split(F.regexp_replace(body, "[^0-9]", ""), ""))

    def worth(d, j):
        twice = d.cast("int") * 2
        return F.when(j % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    total = F.aggregate(F.transform(digits, worth), F.lit(0), lambda s, x: s + x)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def _email(v: Column, key: str, reverse: bool) -> Column:
    local = F.regexp_extract(v, "^([^@]*)@", 1)
    return F.concat(permute_string(local, key, "email", reverse), F.regexp_extract(v, "(@.*)$", 1))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _laid(v: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``v``, whose other characters stay."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("i"))

    def step(s, c):
        own = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["o"], F.when(own, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("o"),
                        F.when(own, s["i"] + 1).otherwise(s["i"]).alias("i"))

    return F.aggregate(F.split(v, ""), start, step, lambda s: s["o"])


def _card(v: Column, key: str, reverse: bool) -> Column:
    digits = _digits(v)
    body = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
    new = permute_string(body, key, "card", reverse)
    return F.when(check_digit(body) == F.substring(digits, -1, 1), _laid(v, F.concat(new, check_digit(new))))


def _phone(v: Column, key: str, reverse: bool) -> Column:
    digits = _digits(v)
    code = F.regexp_extract(digits, f"^({COUNTRY_CODE})", 1)
    rest = F.substring(digits, F.char_length(code) + 1, F.char_length(digits))
    return _laid(v, F.concat(code, permute_string(rest, key, "phone", reverse)))


def _ip(v: Column, key: str, reverse: bool) -> Column:
    o = lambda k: F.element_at(F.split(v, r"\."), k).cast("int")      # noqa: E731
    x = permute_number(o(1) * 256 + o(2), o(3) * 256 + o(4), 65536, 65536, key, "ip", reverse)
    return F.transform(F.array(x), lambda s: F.concat_ws(
        ".", *[F.floor(s[h] / 256).cast("int").cast("string") if k == 0 else (s[h] % 256).cast("string")
               for h in ("l", "r") for k in (0, 1)]))[0]


def _ssn(v: Column, key: str, reverse: bool) -> Column:
    area, group, serial = (F.substring(v, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    at = area - 1 - F.when(area > 666, 1).otherwise(0)            # 898 areas
    x = permute_number(at * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", reverse)

    def shown(s):
        k = F.floor(s["l"] / 99).cast("int")
        number = k + 1 + F.when(k >= 665, 1).otherwise(0)
        return F.concat_ws("-", *[F.lpad(p.cast("int").cast("string"), n, "0")
                                  for p, n in ((number, 3), (s["l"] % 99 + 1, 2), (s["r"] + 1, 4))])

    return F.when(valid, F.transform(F.array(x), shown)[0])


def _date(v: Column, key: str, reverse: bool) -> Column:
    first = F.to_date(F.concat(F.substring(v, 1, 8), F.lit("01")))
    day = F.substring(v, 9, 2).cast("int")
    index = F.date_diff(first, F.lit(FIRST_DAY).cast("date")) + day - 1
    x = permute_number(F.floor(index / 773), index % 773, DAYS // 773, 773, key, "date", reverse)
    shown = F.transform(F.array(x), lambda s: F.date_format(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * 773 + s["r"]).cast("int")), "yyyy-MM-dd"))[0]
    return F.when(day <= F.dayofmonth(F.last_day(first)), shown)


WORKERS = {"email": _email, "card": _card, "phone": _phone, "ip": _ip, "ssn": _ssn, "date": _date}


def _found(text: Column, key: str, reverse: bool) -> Column:
    """array of struct(kind_no, value): kind_no is null where the value does not validate."""
    def one(v):
        new = F.lit(None).cast("struct<kind_no:int,value:string>")
        for no in range(len(KINDS) - 1, -1, -1):
            kind = KINDS[no]
            value = WORKERS[kind](v, key, reverse)
            new = F.when(v.rlike(f"^(?:{PATTERNS[kind]})$"),
                         F.struct(F.when(value.isNotNull(), no).alias("kind_no"), F.coalesce(value, v).alias("value"))).otherwise(new)
        return F.coalesce(new, F.struct(F.lit(None).cast("int").alias("kind_no"), v.alias("value")))

    return F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), one)


def pseudonymise(docs: DataFrame, key: str = KEY, reverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the number of values of each kind (n_email ...)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in (*COUNTS, "__found")])
    text = F.col("text")
    none = F.array().cast("array<struct<kind_no:int,value:string>>")
    found = docs.withColumn("__found", F.when(text.rlike(HINT), _found(text, key, reverse)).otherwise(none))
    pieces = F.split(text, ANY, -1)
    glued = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), F.col("__found.value").alias("v")),
                                     lambda z: F.concat(z["p"], F.coalesce(z["v"], F.lit("")))), "")
    count = lambda no: F.size(F.filter("__found", lambda f: f["kind_no"] == no)).cast("long")       # noqa: E731
    return (found.withColumn("text", F.when(F.size("__found") > 0, glued).otherwise(text))
            .withColumns({c: count(no) for no, c in enumerate(COUNTS)}).drop("__found"))


def restore(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The inverse of ``pseudonymise`` under the same key."""
    return pseudonymise(docs, key, reverse=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
