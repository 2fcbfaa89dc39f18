"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions only.

Every whole text is searched for e-mail addresses, social security numbers,
dates, IPv4 addresses, telephone numbers and payment card numbers. What passes
its validation (a real calendar date, the Luhn digit of a card, number ranges)
is replaced by another valid value of the same format: the value is a number
below a * b, and a keyed generalised Feistel network permutes 0 .. a*b - 1
without gaps. The key and the kind decide the permutation, so
equal values get equal pseudonyms in all documents and, with the key, ``reveal``
takes them back. Separators stay as written.

| kind | range | kept |
| --- | --- | --- |
| card | all digits between the first and the last | first digit; the last is the new Luhn digit; a number that follows is no part |
| phone, North America | ten digits, also of area codes that are not given out | a leading 1 |
| phone, others with + | the third to the twentieth digit | first two digits, any beyond |
| ssn | area 001-899 but 666, group 01-99, serial 0001-9999 | |
| ip | 32 bits | |
| date | 1800 to 2199, days of the same widths (cycle walk past unreal ones) | the way it is written; month names are not read |
| email | each run of up to 10 letters and digits before the @ | the domain, other signs |

Null texts stay null. Texts without such values come back as they are; texts of any
length are read whole. Repeated rows are treated alike, each for itself; an empty
table gives an empty one. Where two formats begin at one place, the first of the
pattern wins: which text is a value depends on its shape alone, but for a card that a
short number follows. Other columns pass through, whatever their names; columns with
the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8

# The formats looked for.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])"
ISO_DATE = r"(?<![0-9A-Za-z-])(?:1[89]|2[01])[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9A-Za-z-])"
SLASH_DATE = r"(?<![0-9A-Za-z./])[0-9]{1,2}([./])[0-9]{1,2}\1(?:1[89]|2[01])[0-9]{2}(?![0-9A-Za-z]|[./][0-9])"
YEAR_DATE = r"(?<![0-9A-Za-z./])(?:1[89]|2[01])[0-9]{2}/[0-9]{1,2}/[0-9]{1,2}(?![0-9A-Za-z]|/[0-9])"
IP = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
NANP = r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
WORLD = r"(?<![0-9A-Za-z+])\+[2-9][0-9](?:[ .-]?\(?[0-9]{1,4}\)?){2,5}(?![0-9A-Za-z])"
CARD_ONE = r"(?<![0-9A-Za-z])(?<![A-Za-z]-)[0-9]{13,19}(?![0-9A-Za-z]|-[A-Za-z])"
CARD_FOURS = r"(?<![0-9A-Za-z-])[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{1,3})?(?![0-9A-Za-z]|-[A-Za-z])"
CARD_PARTS = r"(?<![0-9A-Za-z-])(?![0-9](?:[ -]?[0-9]){0,18}?[0-9]{12})[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z-])"
PATTERN = "|".join((EMAIL, SSN, ISO_DATE, SLASH_DATE, YEAR_DATE, IP, NANP, WORLD, CARD_ONE, CARD_FOURS, CARD_PARTS))  # \\1 is the only group's
FIRST_YEAR, YEARS = 1800, 400
CARD_WALK, DATE_WALK = 400, 20  # steps of a cycle walk; a value needs more with a chance below 1e-18


def _feistel(value: Column, a: Column, b: Column, tweak: Column, key: str, back: bool) -> Column:
    """The pseudonym of ``value`` below a * b, or with ``back`` the value of a pseudonym."""
    def mixed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("bigint")

    def size(i: Column) -> Column:
        return F.when(i % 2 == 1, a).otherwise(b)

    def there(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + mixed(i, s["r"]), size(i)).alias("r"))

    def again(s: Column, i: Column) -> Column:
        return F.struct(F.pmod(s["r"] - mixed(i, s["l"]), size(i)).alias("l"), s["l"].alias("r"))

    order = F.array(*map(F.lit, range(ROUNDS, 0, -1) if back else range(1, ROUNDS + 1)))
    start = F.struct(F.call_function("div", value, b).alias("l"), F.pmod(value, b).alias("r"))
    return F.aggregate(order, start, again if back else there, lambda s: s["l"] * b + s["r"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _power(base: int, n: Column) -> Column:
    return F.round(F.pow(F.lit(base), n)).cast("bigint")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, kind: str, key: str, back: bool) -> Column:
    """A string of up to 18 digits permuted among all strings of its length."""
    n = F.length(digits)
    low = F.call_function("div", n, F.lit(2)).cast("int")
    new = _feistel(digits.cast("bigint"), _power(10, low), _power(10, n - low), F.concat_ws("/", F.lit(kind), n.cast("string")), key, back)
    return F.when(n > 0, F.lpad(new.cast("string"), n, "0")).otherwise("")


def _refill(written: Column, digits: Column) -> Column:
    """``written`` with its digits replaced in turn."""
    def whole(new: Column) -> Column:
        def sign(c: Column, i: Column) -> Column:
            nth = F.length(_digits(F.substring(written, F.lit(1), i + 1)))
            return F.when(c.rlike("^[0-9]$"), F.substring(new, nth, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.split(written, ""), sign), "")
    return _let(digits, whole)


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    n = F.length(digits)
    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _walk(start: Column, step, ends, steps: int) -> Column:
    """``step`` repeated until ``ends`` holds. Of a permutation, it is one of the values for which ``ends`` holds."""
    def on(s: Column, i: Column) -> Column:
        ahead = _let(step(s["v"]), lambda v: F.struct(v.alias("v"), ends(v).alias("done")))
        return F.when(s["done"], s).otherwise(ahead)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(start.alias("v"), F.lit(False).alias("done")), on, lambda s: s["v"])


def _card_digits(digits: Column, key: str, back: bool) -> Column:
    """The pseudonym of a card's digits. Of long ones it keeps whether the first 16 would be a card by themselves."""
    def step(d: Column) -> Column:
        head = F.concat(F.substring(d, 1, 1), _permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), "card", key, back))
        return _let(head, lambda h: F.concat(h, F.pmod(10 - _luhn(F.concat(h, F.lit("0"))), F.lit(10)).cast("string")))

    def alone(d: Column) -> Column:
        return _luhn(F.substring(d, 1, 16)) == 0
    return _walk(digits, step, lambda d: (F.length(d) <= 16) | (alone(d) == alone(digits)), CARD_WALK)


def _card(m: Column, key: str, back: bool) -> Column:
    """Four groups of four that are a card are one, whatever short number follows; else the whole run is, if valid."""
    def of(digits: Column) -> Column:
        head = F.substring(digits, 1, 16)
        followed = m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -]") & (_luhn(head) == 0)

        def new(chosen: Column) -> Column:
            rest = F.substring(digits, F.length(chosen) + 1, F.lit(3))
            return F.when(_luhn(chosen) == 0, _refill(m, F.concat(_card_digits(chosen, key, back), rest))).otherwise(m)
        return _let(F.when(followed, head).otherwise(digits), new)
    return _let(_digits(m), of)


def _nanp(m: Column, key: str, back: bool) -> Column:
    digits = F.right(_digits(m), F.lit(10))
    new = _permuted_digits(digits, "phone", key, back)
    lead = F.substring(_digits(m), F.lit(1), F.length(_digits(m)) - 10)
    return _refill(m, F.concat(lead, new))


def _world(m: Column, key: str, back: bool) -> Column:
    digits = _digits(m)
    new = _permuted_digits(F.substring(digits, 3, 18), "world", key, back)
    return _refill(m, F.concat(F.substring(digits, 1, 2), new, F.substring(digits, F.lit(21), F.length(digits))))


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    a, b = F.lit(898 * 99).cast("bigint"), F.lit(9999).cast("bigint")
    nth = F.when(area > 666, area - 2).otherwise(area - 1)
    new = _feistel((nth * 99 + group - 1) * b + serial - 1, a, b, F.lit("ssn"), key, back)
    head = F.call_function("div", new, b)
    nth = F.call_function("div", head, F.lit(99).cast("bigint"))
    return F.concat_ws("-", F.lpad(F.when(nth >= 665, nth + 2).otherwise(nth + 1).cast("string"), 3, "0"),
                       F.lpad((head % 99 + 1).cast("string"), 2, "0"), F.lpad((new % b + 1).cast("string"), 4, "0"))


def _ip(m: Column, key: str, back: bool) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("bigint"), lambda s, x: s * 256 + x.cast("bigint"))
    half = F.lit(65536).cast("bigint")
    new = _feistel(value, half, half, F.lit("ip"), key, back)
    return F.concat_ws(".", *[(F.shiftright(new, s).bitwiseAND(F.lit(255).cast("bigint"))).cast("string") for s in (24, 16, 8, 0)])


def _date(m: Column, key: str, back: bool) -> Column:
    """A date in another of the same widths: a day below 10, to 12 or above and a month below 10 or above stay such.

    So every way of writing a day gives the same pseudonym and shows in it which field is the day.
    """
    def read(part: Column) -> Column:
        def number(i: int) -> Column:
            return F.get(part, F.lit(i)).cast("int")

        year_first = F.length(F.get(part, F.lit(0))) == 4
        month_first = m.contains("/") & (number(1) > 12)
        order = F.when(year_first, F.struct(*_named(0, 1, 2))).when(month_first, F.struct(*_named(2, 0, 1))).otherwise(F.struct(*_named(2, 1, 0)))
        return _let(order, lambda at: _let(F.struct(*[F.get(part, at[f]).cast("int").alias(f) for f in "ymd"]), lambda date: new(part, at, date)))

    def real(date: Column) -> Column:
        written = F.concat_ws("-", date["y"].cast("string"), *[F.lpad(date[f].cast("string"), 2, "0") for f in "md"])
        return F.try_to_date(written, "yyyy-MM-dd").isNotNull()

    def new(part: Column, at: Column, date: Column) -> Column:
        day = F.when(date["d"] < 10, F.array(F.lit(1), F.lit(9))).when(date["d"] <= 12, F.array(F.lit(10), F.lit(3))).otherwise(
            F.array(F.lit(13), F.lit(19)))
        month = F.when(date["m"] < 10, F.array(F.lit(1), F.lit(9))).otherwise(F.array(F.lit(10), F.lit(3)))
        sizes = F.concat(day, month).cast("array<bigint>")

        def permuted(size: Column) -> Column:
            first_day, days, first_month, months = (F.get(size, F.lit(i)) for i in range(4))

            def fields(v: Column) -> Column:
                rest = F.call_function("div", v, days)
                return F.struct((F.call_function("div", rest, months) + FIRST_YEAR).alias("y"), (rest % months + first_month).alias("m"),
                                (v % days + first_day).alias("d"))

            value = ((date["y"] - FIRST_YEAR) * months + date["m"] - first_month) * days + date["d"] - first_day
            tweak = F.concat_ws("/", F.lit("date"), first_day.cast("string"), first_month.cast("string"))
            found = _walk(value, lambda v: _feistel(v, YEARS * months, days, tweak, key, back), lambda v: real(fields(v)), DATE_WALK)
            return _let(found, lambda v: _let(fields(v), written))

        def written(to: Column) -> Column:
            places = [F.lpad(F.when(at["y"] == i, to["y"]).when(at["m"] == i, to["m"]).otherwise(to["d"]).cast("string"),
                             F.length(F.get(part, F.lit(i))), "0") for i in range(3)]
            return _refill(m, F.concat(*places))

        valid = real(date) & date["m"].between(1, 12) & date["d"].between(1, 31)
        return F.when(valid, _let(sizes, permuted)).otherwise(m)

    return _let(F.split(m, "[./-]"), read)


def _named(year: int, month: int, day: int) -> list[Column]:
    return [F.lit(n).alias(f) for f, n in (("y", year), ("m", month), ("d", day))]


def _email(m: Column, key: str, back: bool) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)  # a match has one @

    def part(p: Column) -> Column:
        n = F.length(p)
        low = F.call_function("div", n, F.lit(2)).cast("int")
        value = F.conv(F.lower(p), 36, 10).cast("bigint")
        new = _feistel(value, _power(36, low), _power(36, n - low), F.concat_ws("/", F.lit("email"), n.cast("string")), key, back)
        return F.when(p.rlike("^[A-Za-z0-9]"), F.lpad(F.lower(F.conv(new.cast("string"), 10, 36)), n, "0")).otherwise(p)

    parts = F.regexp_extract_all(local, F.lit("[A-Za-z0-9]{1,10}|[^A-Za-z0-9]+"), 0)
    return F.concat(F.array_join(F.transform(parts, part), ""), F.lit("@"), domain)


def _kind(m: Column) -> Column:
    """Which format a match has."""
    found = F.when(m.contains("@"), "email").when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
    found = found.when(m.rlike("^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"), "iso_date")
    found = found.when(m.rlike("^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}$"), "day_date")
    found = found.when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(m.rlike(rf"^{NANP}$"), "nanp")
    return found.when(m.startswith("+"), "world").otherwise("card")


def _replaced(m: Column, key: str, back: bool) -> Column:
    makers = {"email": _email, "ssn": _ssn, "iso_date": _date, "day_date": _date, "ip": _ip, "nanp": _nanp, "world": _world}
    kind, found = _kind(m), F
    for name, make in makers.items():
        found = found.when(kind == name, make(m, key, back))
    return found.otherwise(_card(m, key, back))


def _with_replacements(docs: DataFrame, text_col: str, key: str, back: bool) -> DataFrame:
    text = F.col(f"`{text_col}`")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn("found__", found)
    marked = marked.withColumn("new__", F.transform("found__", lambda m: _replaced(m, key, back)))
    gaps = F.split(text, PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(gaps, F.concat(F.col("new__"), F.array(F.lit(""))), lambda gap, new: F.array(gap, new))), "")
    return marked.withColumn("woven__", F.when(F.size("found__") > 0, woven).otherwise(text))


def _renamed(docs: DataFrame, text_col: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with numbered columns, its text as ``text``, so that names of its own meet none of these."""
    names = ["text" if c == text_col else f"c{i}__" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's values replaced, and ``n_values``, how many were, and ``kinds``, of which formats."""
    docs = docs.drop("n_values", "kinds")
    rows, names = _renamed(docs, text_col)
    found = _with_replacements(rows, "text", key, False)
    changed = F.filter(F.arrays_zip("found__", "new__"), lambda z: z["found__"] != z["new__"])
    kinds = F.array_sort(F.array_distinct(F.transform(changed, lambda z: _kind(z["found__"]))))
    found = found.withColumns({"n_values": F.coalesce(F.size(changed), F.lit(0)).cast("bigint"), "kinds": F.concat_ws(",", kinds)})
    return found.withColumn("text", F.col("woven__")).select(*names, "n_values", "kinds").toDF(*docs.columns, "n_values", "kinds")


def reveal(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The texts before ``pseudonymise`` with the same key (addresses in lower case before the @)."""
    rows, names = _renamed(docs, text_col)
    found = _with_replacements(rows, "text", key, True)
    return found.withColumn("text", F.col("woven__")).select(*names).toDF(*docs.columns)
