"""Personal data: format-preserving pseudonyms by keyed Feistel permutation. DataFrame functions only.

One pattern finds candidates; each is validated by its kind's rule and, if valid,
replaced within its format. A Feistel network over the value's own domain is a
permutation there, so equal values get equal pseudonyms in every document, different
ones different ones, and whoever has the key can invert it.

- payment cards: 13 to 19 digits with a valid Luhn digit; the digits before it are
  permuted, the check digit is computed anew, separators stay
- bank accounts (IBAN): valid mod 97; the digits are permuted, letters stay, check digits anew
- telephone numbers: North American ones keep valid area and exchange codes; others keep the
  country code, written apart, or else of two digits (1 and 7 alone)
- social security numbers: valid ranges are kept
- IPv4 addresses: each half is permuted
- dates: yyyy-mm-dd, yyyy/mm/dd, dd/mm/yyyy, mm/dd/yyyy, dd.mm.yyyy from 1900 to 2099; permuted as days, so one
  date in two formats stays one date
- mail addresses and secrets are no numbers: a keyed hash of the value, of 128 bits or as long
  as the value, so that different ones don't meet in a corpus of any size

A null text stays null, an empty one empty; what fails its rule stays as it is, and so does all
other text. The time is linear in a text's length. Rows don't affect each other: ties and repeated
rows change nothing. An empty table gives no rows. Extra columns pass through, whatever their
names; one named found is replaced.

The key is an argument. The query takes it from the session's ``spark.duecall.pii.key``, and
where that is unset, as in tests, uses a demonstration key that keeps nothing secret.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecall.llm.common import ROW, documents, let, packed, unpacked

KEY, KEY_SETTING = "demo-key-1", "spark.duecall.pii.key"
ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 are 17 x 4297.
EPOCH, DAY_ROWS, DAY_COLUMNS = "1900-01-01", 17, 4297

#: A secret's value has 16 characters or more and goes on to its end, parts between dots included; a dot at its end is the sentence's.
SECRET_NAME = r"(?i:token|secret|password|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?"
SECRET_VALUE = r"(?=[A-Za-z0-9+/_.=-]{15,}?[A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]++(?:\.++[A-Za-z0-9+/_=-]++)*+"

#: Candidates by kind, tried in this order at each place. Repetition is possessive or bounded: the time is linear in the text.
PATTERNS = {
    "secret": rf"(?<![\w]){SECRET_NAME}{SECRET_VALUE}\"?",
    "email": r"(?<![\p{L}\p{N}_.%+-])[\p{L}\p{N}_.%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}+",
    "iban": r"(?<![\w])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w])",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w]|[./-]\d)",
    "phone": r"(?<![\w+])(?:(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-](?:\(?\d{2,4}\)?[ .-]){1,4}\d{2,8}|\+\d{8,15})(?![\w]|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w]|[.-]\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
}
PATTERN = "|".join(PATTERNS.values())


def digest(kind: str, key: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), value).cast("binary"), 256)


def permuted(kind: str, key: str, left: Column, right: Column, rows: Column, columns: Column) -> Column:
    """struct(x, y): the keyed permutation of (left, right) in rows x columns.

    Round by round the side that stays is hashed with the key, and the hash is added to
    the other side modulo that side's size; then the sides swap.
    """

    def turn(s: Column, i: Column) -> Column:
        own = F.when(i % 2 == 0, rows).otherwise(columns)
        mixed = F.conv(F.substring(digest(kind, key, F.concat_ws("|", i.cast("string"), s["y"].cast("string"))), 1, 14), 16, 10).cast("long")
        return F.struct(s["y"].alias("x"), F.pmod(s["x"] + F.pmod(mixed, own), own).alias("y"))

    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width.cast("int"), "0")


def power(n: Column) -> Column:
    """10^n, exact up to 10^18."""
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def shaped(form: Column, new: Column) -> Column:
    """form with its digits replaced by those of new, in order."""

    def letter(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.substr(new, F.length(digits(F.substr(form, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), letter), "")


def scrambled(kind: str, key: str, number: Column) -> Column:
    """The permutation of a string of up to 36 digits among those of its length."""

    def of(s: Column) -> Column:
        first = F.floor(F.length(s) / 2).cast("int")
        last = F.length(s) - first
        left = F.when(first > 0, F.substr(s, F.lit(1), first)).otherwise("0").cast("long")
        pair = permuted(kind, key, left, F.substr(s, first + 1).cast("long"), power(first), power(last))
        return let(pair, lambda p: F.concat(F.when(first > 0, padded(p["x"], first)).otherwise(""), padded(p["y"], last)))

    return let(number, of)


def luhn(body: Column) -> Column:
    """The check digit after body."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(body, i, F.lit(1)).cast("int")
        doubled = F.pmod(F.length(body) - i, F.lit(2)) == 0
        return total + F.when(doubled & (d > 4), d * 2 - 9).when(doubled, d * 2).otherwise(d)

    return F.pmod(10 - F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add), F.lit(10)), F.lit(10)).cast("string")


def card(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        new = let(scrambled("card", key, body), lambda b: F.concat(b, luhn(b)))
        return F.when(luhn(body) == F.substr(d, F.length(d)), shaped(m, new))

    return let(digits(m), of)


def remainder(text: Column) -> Column:
    """text, letters as 10 to 35, modulo 97."""

    def add(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, F.pmod(r * 100 + code - 55, F.lit(97))).otherwise(F.pmod(r * 10 + code - 48, F.lit(97)))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), add)


def iban(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        country, rest = F.substr(d, F.lit(1), F.lit(2)), F.substr(d, F.lit(5))
        inner = let(rest, lambda r: shaped(r, scrambled("iban", key, digits(r))))
        new = let(inner, lambda r: F.concat(padded(98 - remainder(F.concat(r, country, F.lit("00"))), F.lit(2)), digits(r)))
        ok = (remainder(F.concat(rest, F.substr(d, F.lit(1), F.lit(4)))) == 1) & (F.length(digits(rest)) > 1)
        return F.when(ok, shaped(m, new))

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def phone(key: str, m: Column) -> Column:
    def north(d: Column) -> Column:
        n = F.substr(d, F.length(d) - 9)
        area, exchange, line = (F.substr(n, F.lit(a), F.lit(k)).cast("long") for a, k in ((1, 3), (4, 3), (7, 4)))
        pair = permuted("phone", key, area - 200, (exchange - 200) * 10_000 + line, F.lit(800), F.lit(8_000_000))
        lead = F.substr(d, F.lit(1), F.length(d) - 10)
        new = let(pair, lambda p: F.concat(lead, padded(p["x"] + 200, F.lit(3)), padded(F.floor(p["y"] / 10_000) + 200, F.lit(3)), padded(F.pmod(p["y"], F.lit(10_000)), F.lit(4))))
        return F.when((area >= 200) & (exchange >= 200), shaped(m, new))

    def abroad(d: Column) -> Column:
        code = F.when(m.rlike(r"^\+\d{8,15}$"), F.regexp_extract(m, r"^\+([17]|\d\d)", 1)).otherwise(F.regexp_extract(m, r"^\+(\d{1,3})", 1))
        rest = F.substr(d, F.length(code) + 1)
        return F.when(F.length(d).between(8, 15), shaped(m, F.concat(code, scrambled("phone", key, rest))))

    plain = m.rlike(r"^(\+?1[ .-]?)?(\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$|^\+1\d{10}$")
    return let(digits(m), lambda d: F.when(plain, north(d)).otherwise(abroad(d)))


def ssn(key: str, m: Column) -> Column:
    def of(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(a), F.lit(k)).cast("long") for a, k in ((1, 3), (4, 2), (6, 4)))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        place = area - F.when(area > 666, 2).otherwise(1)
        pair = permuted("ssn", key, place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
        back = lambda p: F.concat(padded(p["x"] + F.when(p["x"] >= 665, 2).otherwise(1), F.lit(3)), padded(F.floor(p["y"] / 9999) + 1, F.lit(2)), padded(F.pmod(p["y"], F.lit(9999)) + 1, F.lit(4)))
        return F.when(ok, shaped(m, let(pair, back)))

    return let(digits(m), of)


def ip(key: str, m: Column) -> Column:
    def of(o: Column) -> Column:
        pair = permuted("ip", key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536))
        new = let(pair, lambda p: F.concat_ws(".", *(x.cast("long").cast("string") for half in (p["x"], p["y"]) for x in (F.floor(half / 256), F.pmod(half, F.lit(256))))))
        return F.when(F.forall(o, lambda x: x < 256), new)

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), of)


#: How dates are written, by what their text looks like; where day and month can't be told, the day comes first.
DATES = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{4}/", "yyyy/MM/dd"), (r"^\d{2}/", "dd/MM/yyyy"), (r"^\d{2}/", "MM/dd/yyyy"), (r"^\d{2}\.", "dd.MM.yyyy"))


def date(key: str, m: Column) -> Column:
    def moved(form: str) -> Callable[[Column], Column]:
        def of(day: Column) -> Column:
            n = F.date_diff(day, F.lit(EPOCH).cast("date"))
            pair = permuted("date", key, F.floor(n / DAY_COLUMNS), F.pmod(n, F.lit(DAY_COLUMNS)), F.lit(DAY_ROWS), F.lit(DAY_COLUMNS))
            new = let(pair, lambda p: F.date_format(F.date_add(F.lit(EPOCH).cast("date"), (p["x"] * DAY_COLUMNS + p["y"]).cast("int")), form))
            return F.when(n.between(0, DAY_ROWS * DAY_COLUMNS - 1), new)

        return of

    return F.coalesce(*(F.when(m.rlike(looks), let(F.try_to_date(m, form), moved(form))) for looks, form in DATES))


def email(key: str, m: Column) -> Column:
    return F.concat(F.lit("user-"), F.substring(digest("email", key, F.lower(m)), 1, 32), F.lit("@example.invalid"))


def secret(key: str, m: Column) -> Column:
    def of(value: Column) -> Column:
        length = F.length(value)
        new = F.substr(F.repeat(digest("secret", key, value), F.ceil(length / 64).cast("int")), F.lit(1), length)
        return F.concat(F.regexp_extract(m, f"^{SECRET_NAME}", 0), new, F.when(m.endswith('"'), '"').otherwise(""))

    return let(F.regexp_extract(m, f"^{SECRET_NAME}({SECRET_VALUE})", 1), of)


KINDS = {"secret": secret, "email": email, "iban": iban, "date": date, "phone": phone, "ssn": ssn, "card": card, "ip": ip}


def judged(key: str, m: Column) -> Column:
    """struct(kind, value): the pseudonym of a match, or nulls where it isn't valid."""
    whole = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    named = lambda kind: lambda v: F.struct(F.when(v.isNotNull(), F.lit(kind)).alias("kind"), v.alias("value"))
    for kind, make in reversed(KINDS.items()):
        out = F.when(whole(kind), let(make(key, m), named(kind))).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced by its pseudonymised form, and a column ``found``: the kind of each replaced value, in order."""
    none = F.array().cast("array<string>")

    def of(text: Column) -> Column:
        def with_matches(matches: Column) -> Column:
            def joined(found: Column) -> Column:
                back = F.transform(F.split(text, PATTERN, -1), lambda piece, i: F.concat(piece, F.coalesce(F.get(found, i)["new"]["value"], F.get(found, i)["old"], F.lit(""))))
                kinds = F.filter(F.transform(found, lambda x: x["new"]["kind"]), lambda k: k.isNotNull())
                return F.struct(F.array_join(back, "").alias("text"), kinds.alias("found"))

            some = let(F.transform(matches, lambda m: F.struct(m.alias("old"), judged(key, m).alias("new"))), joined)
            return F.when(F.size(matches) > 0, some).otherwise(F.struct(text.alias("text"), none.alias("found")))

        return let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), with_matches)

    text = F.col(f"{ROW}.text")
    out = packed(docs).withColumn("done", F.when(text.isNotNull(), let(text, of)))
    return unpacked(out, docs.columns, text=F.col("done.text"), found=F.coalesce("done.found", none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), spark.conf.get(KEY_SETTING, KEY))
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), F.array_join("found", ",").alias("kinds"), "text")
