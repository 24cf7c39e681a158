r"""Personal data: format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

One pattern finds candidates; each is validated by its kind (Luhn sum, mod-97 sum, octets, calendar,
numbering plan) and, if valid, permuted within its format: digits stay digits, check digits are
made anew, dates stay dates, addresses stay addresses. The permutation depends on the key, the kind and the
value alone, not on how it is written: a number is permuted without its separators (a telephone number without
country code 1, an address' local part in lower case) and then laid into the original's form. So equal values get
equal pseudonyms in all documents and forms, and different values different ones.

Strings (cards, accounts, telephone numbers, local parts of mail addresses, secrets) go through a network over their two
halves: in each round every character of one half moves within its own alphabet by a keyed stream
made from the other half. Numbers with a fixed domain (addresses, dates, social security numbers) go
through a network over Z_a x Z_b. Both can be undone round by round, hence are one to one.

Accounts and cards are marked before: at every place where one may start, also within a candidate that is none, the longest
start that is valid is taken, so words and numbers around it stay text. Cards come without separators or in their
usual groups. A start within an earlier valid one is not tried.

A secret runs to its last character that is no dot, whatever its length; dots at its end are the sentence's.

The text between the candidates is untouched and a text without candidates comes back as it is; the four
noncharacters that serve as marks are taken out of a text in which something is replaced.
Nulls: a null text stays null with no replacements. Empty, long and repeated texts need nothing special.
Other columns of the input pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bound, texts

ROUNDS = 8
L, R = F.lit, F.regexp_replace

#: Patterns of candidates by kind, in the order in which they are tried at a place.
CANDIDATES: list[tuple[str, str]] = [
    ("email", r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    ("secret", r"(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_+/=\-][A-Za-z0-9_+/=.\-]{6,}[A-Za-z0-9_+/=\-]|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("iban", "\ufdd1[A-Z0-9 ]+\ufdd2"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("date", r"(?<![\d./\-])(?:\d{4}([./\-])\d{1,2}\1\d{1,2}|\d{1,2}([./\-])\d{1,2}\2\d{4})(?![./\-]?\d)"),
    ("ssn", r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    ("phone", r"(?<![\d\p{L}+(])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d\p{L}+])\+[2-9]\d{0,2}(?:[ .\-]?\(?\d{1,5}\)?){2,6}(?!\d)"),
    ("card", "\ufdd3[0-9 \\-]+\ufdd4"),
]
#: Where an account or card may start, how far it may reach, and the forms of a card. Marked accounts are left alone.
STARTS = {
    "iban": (r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11})", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?:[A-Za-z0-9]|)"),
    "card": ("(?<![\\d\\p{L}])(?=\\d(?:[ \\-]?\\d){12})(?![^\ufdd1\ufdd2]{0,60}\ufdd2)", r"\d(?:[ \-]?\d){12,18}(?:[\d\p{L}@]|)"),
}
CARD = r"^(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ \-])\d{4}\2\d{4}\2\d{4}\2\d{3}|\d{4}([ \-])\d{6}\3\d{4,5})$"
PATTERN = "|".join(p for _, p in CANDIDATES)
#: Set around a valid account or card while a text is scanned.
MARKS = {"iban": "\ufdd1\ufdd2", "card": "\ufdd3\ufdd4"}
ALL_MARKS = "".join(MARKS.values())
#: Starts that may lie within one account or card.
INNER = 8
#: Days from 1900-01-01 that dates are permuted among: 251 * 292, till 2100.
DATE_A, DATE_B, FIRST_DAY = 251, 292, "1900-01-01"


def _stream(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", L(key), *parts), 512)


def numbers(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str) -> Column:
    """A keyed permutation of Z_a x Z_b; returns a struct (a, b)."""

    def moved(x: Column, by: Column, i: Column, size: int) -> Column:
        return F.pmod(x + F.conv(F.substring(_stream(key, L(kind), i, by), 1, 12), 16, 10).cast("long"), L(size).cast("long"))

    def turn(s: Column, i: Column) -> Column:
        first = F.struct(moved(s["a"], s["b"], i, size_a).alias("a"), s["b"].alias("b"))
        return F.when(i % 2 == 0, first).otherwise(F.struct(s["a"].alias("a"), moved(s["b"], s["a"], i, size_b).alias("b")))

    return F.aggregate(F.sequence(L(0), L(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def default_mask(s: Column) -> Column:
    """The alphabet of each character: a, A and 9 stand for letters and digits, anything else stays."""
    return R(R(R(s, L("[A-Z]"), L("A")), L("[a-z]"), L("a")), L("[0-9]"), L("9"))


def string(s: Column, mask: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of one mask; 8 in a mask stands for the digits from 2."""

    def moved(x: Column, m: Column, keyed: Column) -> Column:
        return F.when(F.length(x) == 0, x).otherwise(bound(keyed, lambda stream: chars(x, m, stream)))

    def chars(x: Column, m: Column, stream: Column) -> Column:
        def char(i: Column) -> Column:
            c, a = F.substring(x, i, L(1)), F.substring(m, i, L(1))
            base = F.when(a == "9", 48).when(a == "8", 50).when(a == "a", 97).when(a == "A", 65)
            size = F.when(a == "9", 10).when(a == "8", 8).otherwise(26)
            k = F.conv(F.substring(stream, (i - 1) % 64 * 2 + 1, L(2)), 16, 10).cast("int")
            return F.when(base.isNull(), c).otherwise(F.char(base + F.pmod(F.ascii(c) - base + k, size)))

        return F.array_join(F.transform(F.sequence(L(1), F.length(x)), char), "")

    half = (F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, L(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"), F.substring(mask, L(1), half).alias("ma"), F.substring(mask, half + 1, F.length(s)).alias("mb"))

    def turn(t: Column, i: Column) -> Column:
        a = F.struct(moved(t["a"], t["ma"], _stream(key, L(kind), i, t["b"])).alias("a"), t["b"].alias("b"), t["ma"].alias("ma"), t["mb"].alias("mb"))
        b = F.struct(t["a"].alias("a"), moved(t["b"], t["mb"], _stream(key, L(kind), i, t["a"])).alias("b"), t["ma"].alias("ma"), t["mb"].alias("mb"))
        return F.when(i % 2 == 0, a).otherwise(b)

    return bound(F.aggregate(F.sequence(L(0), L(ROUNDS - 1)), start, turn), lambda out: F.concat(out["a"], out["b"]))


def _digits(s: Column) -> Column:
    return R(s, L("[^0-9]"), L(""))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right, every second one doubled; doubled: 1 if that starts with the second."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i, L(1)).cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(L(0), n - 1), worth), L(0), lambda s, x: s + x)


def mod97(account: Column) -> Column:
    """Remainder of an account number with its first four characters moved to the end."""
    s = F.concat(F.substring(account, L(5), F.length(account)), F.substring(account, 1, 4))

    def add(r: Column, i: Column) -> Column:
        c = F.ascii(F.substring(s, i, L(1)))
        return F.when(c < 58, (r * 10 + c - 48) % 97).otherwise((r * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(L(1), F.length(s)), L(0), add)


def laid(m: Column, new: Column) -> Column:
    """m with its ASCII letters and digits replaced, in order, by the characters of new."""
    start = F.struct(L("").alias("out"), L(1).alias("at"))

    def step(s: Column, g: Column) -> Column:
        ours = g.rlike("^[A-Za-z0-9]")
        return F.struct(F.concat(s["out"], F.when(ours, F.substring(new, s["at"], F.length(g))).otherwise(g)).alias("out"), (s["at"] + F.when(ours, F.length(g)).otherwise(0)).alias("at"))

    return F.aggregate(F.regexp_extract_all(m, L("[A-Za-z0-9]+|[^A-Za-z0-9]+"), L(0)), start, step)["out"]


def _card(m: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        body = F.substring(digits, L(1), F.length(digits) - 1)
        checked = bound(string(body, default_mask(body), key, "card"), lambda new: F.concat(new, ((10 - luhn_sum(new, 0) % 10) % 10).cast("string")))
        return F.when(luhn_sum(digits, 1) % 10 == 0, bound(checked, lambda new: laid(m, new)))

    return bound(_digits(m), made)


def _iban(m: Column, key: str) -> Column:
    def made(account: Column) -> Column:
        rest = F.substring(account, L(5), F.length(account))

        def checked(new: Column) -> Column:
            check = 98 - mod97(F.concat(F.substring(account, 1, 2), L("00"), new))
            return F.concat(F.substring(account, 1, 2), F.lpad(check.cast("string"), 2, "0"), new)

        permuted = bound(string(rest, default_mask(rest), key, "iban"), checked)
        return F.when(mod97(account) == 1, bound(permuted, lambda new: laid(m, new)))

    return bound(F.replace(m, L(" "), L("")), made)


def _ip(m: Column, key: str) -> Column:
    def dotted(p: Column) -> Column:
        return F.concat_ws(".", *(F.floor(p[h] / 256) if i == 0 else p[h] % 256 for h in "ab" for i in (0, 1)))

    def made(o: Column) -> Column:
        return F.when(F.forall(o, lambda x: x <= 255), bound(numbers(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip"), dotted))

    return bound(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), made)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *p).cast("int") for p in ((1, 3), (5, 2), (8, 4)))
    # areas 001 to 899 without 666 are numbered from 0
    p = numbers((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")

    def dashed(p: Column) -> Column:
        a = F.floor(p["a"] / 99) + 1
        return F.concat_ws("-", F.lpad((a + F.when(a >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((p["a"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["b"] + 1).cast("string"), 4, "0"))

    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), bound(p, dashed))


def _date(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, r"[./\-]", 0)

    def day(y: Column, mo: Column, d: Column) -> Column:
        return F.datediff(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), L("yyyy-MM-dd")).cast("date"), L(FIRST_DAY).cast("date"))

    def part(x: Column, like: Column) -> Column:
        return F.lpad(x.cast("string"), F.greatest(F.length(x.cast("string")), F.length(like)), L("0"))

    def read(parts: Column) -> Column:
        """Day and the order of the parts: year first, else day first if that is a date, else month first."""
        dmy = F.struct(day(parts[2], parts[1], parts[0]).alias("n"), F.array(L(2), L(1), L(0)).alias("at"))
        mdy = F.struct(day(parts[2], parts[0], parts[1]).alias("n"), F.array(L(2), L(0), L(1)).alias("at"))
        iso = F.struct(day(parts[0], parts[1], parts[2]).alias("n"), F.array(L(0), L(1), L(2)).alias("at"))
        return F.when(F.length(parts[0]) == 4, iso).otherwise(bound(dmy, lambda x: F.when(x["n"].isNotNull(), x).otherwise(mdy)))

    def write(parts: Column, n: Column, at: Column) -> Column:
        moved = bound(numbers(F.floor(n / DATE_B), n % DATE_B, DATE_A, DATE_B, key, "date"), lambda p: F.date_add(L(FIRST_DAY).cast("date"), (p["a"] * DATE_B + p["b"]).cast("int")))

        def joined(new: Column) -> Column:
            fields = F.array(*(part(f(new), F.get(parts, at[i])) for i, f in enumerate((F.year, F.month, F.dayofmonth))))
            return F.array_join(F.transform(F.sequence(L(0), L(2)), lambda i: fields[(F.array_position(at, i) - 1).cast("int")]), "-")

        return F.when((n >= 0) & (n < DATE_A * DATE_B), F.replace(bound(moved, joined), L("-"), mark))

    return bound(F.split(m, r"[./\-]"), lambda parts: bound(read(parts), lambda r: write(parts, r["n"], r["at"])))


def _phone(m: Column, key: str) -> Column:
    # numbers of ten digits keep their country code, and 0 or 1 where area and exchange should not start
    # with them: such numbers are written as telephone numbers though they were not dealt out
    pre = F.regexp_extract(m, r"^(?:\+?1[ .\-]?)?", 0)
    rest = F.substring(m, F.length(pre) + 1, F.length(m))
    plan = r"^\D*\d\d\d\D*\d\d\d\D*\d{4}$"

    def first(digits: Column, at: int) -> Column:
        return F.when(F.substring(digits, at, 1) >= "2", L("8")).otherwise(L("x"))

    local = bound(_digits(rest), lambda d: bound(string(d, F.concat(first(d, 1), L("99"), first(d, 4), L("999999")), key, "phone"), lambda new: F.concat(pre, laid(rest, new))))
    # other numbers keep their first two digits
    abroad = bound(_digits(m), lambda d: bound(string(F.substring(d, L(3), F.length(d)), default_mask(F.substring(d, L(3), F.length(d))), key, "phone"), lambda new: laid(m, F.concat(F.substring(d, 1, 2), new))))
    return F.when(rest.rlike(plan), local).when(F.startswith(m, L("+")) & F.length(_digits(m)).between(8, 15) & ~F.startswith(m, L("+1")), abroad)


def _email(m: Column, key: str) -> Column:
    def made(local: Column) -> Column:
        low = F.translate(local, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

        def cased(new: Column) -> Column:
            at = F.sequence(L(1), F.length(local))
            return F.array_join(F.transform(at, lambda i: F.when(F.substring(local, i, L(1)).rlike("[A-Z]"), F.upper(F.substring(new, i, L(1)))).otherwise(F.substring(new, i, L(1)))), "")

        return F.concat(bound(string(low, default_mask(low), key, "email"), cased), L("@"), F.substring_index(m, "@", -1))

    return bound(F.substring_index(m, "@", 1), made)


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(?:AKIA|(?i:password|passwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)", 0)
    value = F.substring(m, F.length(head) + 1, F.length(m))
    return F.concat(head, string(value, default_mask(value), key, "secret"))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(m: Column, key: str) -> Column:
    """struct (kind, new) of a candidate; kind null and new the candidate itself if it isn't valid."""
    out, bare = None, F.translate(m, ALL_MARKS, "")
    for kind, pattern in CANDIDATES:
        alone = F.rlike(m, L(rf"^(?:{pattern})$"))
        out = (F if out is None else out).when(alone, F.struct(L(kind).alias("kind"), MAKERS[kind](bare if kind in MARKS else m, key).alias("new")))
    return F.transform(F.array(out), lambda s: F.struct(F.when(s["new"].isNotNull(), s["kind"]).alias("kind"), F.coalesce(s["new"], bare).alias("new")))[0]


def _reach(candidate: Column, kind: str) -> Column:
    """Length of the longest start of a candidate that is a valid account or card; null if there is none.

    A candidate may have one character more, which shows that its last group goes on.
    """

    def valid(x: Column) -> Column:
        return (F.length(F.replace(x, L(" "), L(""))) >= 15) & (mod97(F.replace(x, L(" "), L(""))) == 1) if kind == "iban" else F.rlike(x, L(CARD)) & (luhn_sum(_digits(x), 1) % 10 == 0)

    goes_on = "[A-Za-z0-9]" if kind == "iban" else r"[\d\p{L}@]"
    ends = F.filter(F.sequence(L(13), F.length(candidate)), lambda i: ~F.rlike(F.substring(candidate, i + 1, L(1)), L(goes_on)) & F.rlike(F.substring(candidate, i, L(1)), L("[A-Z0-9]")) & valid(F.substring(candidate, L(1), i)))
    return F.try_element_at(ends, L(-1))


def _marked(text: Column, kind: str) -> Column:
    """text with marks around its valid accounts or cards."""
    start, candidate = STARTS[kind]
    begin, end = MARKS[kind]

    def gaps(parts: Column, i: Column) -> list[Column]:
        """Characters from the part m before to part i, for m from 0."""
        out = [L(0)]
        for m in range(1, INNER + 1):
            out.append(out[-1] + F.length(F.get(parts, i - m)))
        return out

    def rebuilt(s: Column) -> Column:
        # parts: what is before the first start (with a sign, so that it is never empty), then from start to start
        parts, reach = s["parts"], s["reach"]

        def first(r: Column, i: Column) -> Column:
            """The reach of a start that does not lie within an earlier one's."""
            inside = [F.coalesce(F.get(reach, i - m) > g, L(False)) for m, g in enumerate(gaps(parts, i)) if m]
            return F.when(~reduce(lambda a, b: a | b, inside), r)

        def shown(kept: Column) -> Column:
            def part(p: Column, i: Column) -> Column:
                left = F.coalesce(*(F.when(F.get(kept, i - m) > g, F.get(kept, i - m) - g) for m, g in reversed(list(enumerate(gaps(parts, i))))))
                ended = F.when(left <= F.length(p), F.concat(F.substring(p, L(1), left), L(end), F.substring(p, left + 1, F.length(p)))).otherwise(p)
                return F.concat(F.when(F.get(kept, i).isNotNull(), L(begin)).otherwise(L("")), ended)

            return F.array_join(F.transform(parts, part), "")

        return bound(F.transform(reach, first), shown)

    signed = F.concat(L(begin), text)
    parts = F.split(signed, start)
    reach = F.concat(F.array(L(None).cast("int")), F.transform(F.regexp_extract_all(signed, L(f"{start}(?=({candidate}))."), L(1)), lambda c: _reach(c, kind)))
    found = bound(F.struct(parts.alias("parts"), reach.alias("reach")), lambda s: F.when(F.exists(s["reach"], lambda r: r.isNotNull()), F.substring(rebuilt(s), L(2), F.length(text) * 2)).otherwise(text))
    return F.when(F.rlike(text, L(start)), found).otherwise(text)


#: Added to the input's columns by `found`.
FOUND = "__pii_found"
#: The text as it is scanned.
SCANNED = "__pii_scanned"


def found(docs: DataFrame, key: str) -> DataFrame:
    """docs with SCANNED and FOUND: an array of structs (kind, new), one for each candidate of the text, in order."""
    text = F.when(F.rlike("text", L(f"[{ALL_MARKS}]")), F.translate("text", ALL_MARKS, "")).otherwise(F.col("text"))
    scanned = bound(_marked(text, "iban"), lambda x: _marked(x, "card"))
    text = F.col(SCANNED)
    all_of = F.when(F.rlike(text, L("[0-9@]|[=:]")), F.regexp_extract_all(text, L(PATTERN), L(0)))
    return docs.withColumn(SCANNED, scanned).withColumn(FOUND, F.transform(all_of, lambda m: pseudonym(m, key)))


def _rebuilt() -> Column:
    new = F.transform(F.col(FOUND), lambda x: x["new"])
    joined = F.array_join(F.zip_with(F.split(F.col(SCANNED), PATTERN), new, lambda a, b: F.concat(a, F.coalesce(b, L("")))), "")
    return F.when(F.exists(FOUND, lambda x: x["kind"].isNotNull()), joined).otherwise(F.col("text"))


def pseudonymised(docs: DataFrame, key: str = "demonstration key") -> DataFrame:
    """docs with its texts' personal data replaced; the columns stay."""
    return found(docs, key).withColumn("text", _rebuilt()).select(*docs.columns)


def op3_pii_pseudonyms(spark, sf_dir: str) -> DataFrame:
    kinds = F.filter(F.transform(F.coalesce(F.col(FOUND), F.array().cast("array<struct<kind:string,new:string>>")), lambda x: x["kind"]), lambda k: k.isNotNull())
    out = found(texts(spark, sf_dir), "demonstration key")
    return out.select("doc_id", _rebuilt().alias("text"), F.size(kinds).cast("long").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds"))
