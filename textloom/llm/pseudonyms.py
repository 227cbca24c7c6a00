"""Format-preserving pseudonyms for personal data, as Spark expressions only.

Every value found is checked (check digits, calendar, number ranges) and then permuted with a
key inside its own format by a Feistel network, so that equal values get equal pseudonyms in all
documents, different values different ones, and the key alone can undo it.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import let

ROUNDS = 10
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = "0123456789abcdef"
#: Dates are permuted among the days from this one on; 200 years.
FIRST_DAY, DAYS = "1900-01-01", 73_049

# Longer halves enter the digests of a round by their own digest; cards, dates, mail addresses and the like are shorter.
LONG_HALF = 100

# A number inside a longer row of groups of digits is read by its own layout, wherever the row starts.
_PHONE = r"(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
_CARDS = r"(?:\d{4}(?:[ \-]\d{4}){3}(?:[ \-]\d{3}(?![ .\-]?\d))?|\d{4}[ \-]\d{6}[ \-]\d{4,5}|\d{13,19})(?!\d)"

# Shapes of personal data and of secrets, in order of preference.
SHAPES = {
    "secret": r"""\b(?i:password|passwd|pwd|token|secret|api[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?(?=(?:\.?[A-Za-z0-9+/_=\-]){8})(?=[A-Za-z+/_=\-]*+(?:\.[A-Za-z+/_=\-]++)*+\.?\d)[A-Za-z0-9+/_=\-]++(?:\.[A-Za-z0-9+/_=\-]++)*+""",
    "access": r"\bAKIA[0-9A-Z]{16}\b",
    "email": r"(?<![\p{L}\p{M}\p{N}._%+\-])[\p{L}\p{M}\p{N}._%+\-]{1,64}+@[\p{L}\p{M}\p{N}\-]{1,63}(?:\.[\p{L}\p{M}\p{N}\-]{1,63})+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "address": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": r"(?<![\d/.\-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\d/\-])",
    "social": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": rf"(?<![\w+])(?:\+\d{{1,3}}[ .\-]?)?{_PHONE}|(?<![\w+])\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,4}}(?!\d)",
    "card": rf"(?<!\d){_CARDS}|(?<!\d)(?!(?:\d+[ \-])+(?:{_PHONE}|{_CARDS}))\d(?:[ \-]?\d){{12,18}}(?!\d)",
}
PATTERN = "|".join(f"(?:{p})" for p in SHAPES.values())


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def feistel(text: Column, alphabets: list[str], key: str, tweak: str, inverse: bool = False) -> Column:
    """``text`` with every character of an alphabet permuted inside that alphabet.

    Each of ten rounds adds to the characters of one half, modulo the size of their alphabet,
    numbers derived from the key and the other half (SHA-512). Other characters stay.
    """
    every = "".join(alphabets)
    base, size = [], []
    for letters in alphabets:
        base += [len(base)] * len(letters)
        size += [len(letters)] * len(letters)
    bases, sizes = (F.array(*[F.lit(x) for x in values]) for values in (base, size))

    def numbers(half: Column, round_no: Column, count: Column) -> Column:
        """Keyed digests, 16 bits or four hex digits per character, 32 characters each."""
        text = let(F.array_join(half, ""), lambda t: F.when(F.size(half) > LONG_HALF, F.sha2(t, 512)).otherwise(t))
        seed = F.concat(F.lit(f"{key}|{tweak}|"), round_no.cast("string"), F.lit("|"), text, F.lit("|"))
        blocks = F.sequence(F.lit(0), F.floor(count / 32).cast("int"))
        return let(seed, lambda start: F.transform(blocks, lambda i: F.sha2(F.concat(start, i.cast("string")), 512)))

    def shifted(half: Column, stream: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            step = F.conv(F.substr(F.get(stream, F.floor(i / 32).cast("int")), i % 32 * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return let(F.position(c, F.lit(every)), lambda at: F.when(at == 0, c).otherwise(F.substr(
                F.lit(every),
                F.get(bases, at - 1) + 1 + F.pmod(
                    at - 1 - F.get(bases, at - 1) + (-step if inverse else step), F.get(sizes, at - 1)),
                F.lit(1))))
        return F.transform(half, char)

    def step(state: Column, i: Column) -> Column:
        if inverse:
            return let(numbers(state["a"], F.lit(ROUNDS - 1) - i, F.size(state["b"])), lambda stream: F.struct(
                shifted(state["b"], stream).alias("a"), state["a"].alias("b")))
        return let(numbers(state["b"], i, F.size(state["a"])), lambda stream: F.struct(
            state["b"].alias("a"), shifted(state["a"], stream).alias("b")))

    def run(chars: Column) -> Column:
        half = F.floor(F.size(chars) / 2).cast("int")
        state = F.struct(F.slice(chars, 1, half).alias("a"), F.slice(chars, half + 1, F.size(chars)).alias("b"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step,
                           lambda s: F.array_join(F.concat(s["a"], s["b"]), ""))

    return let(_chars(text), run)


def _walk(value: Column, move: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """``move`` repeated until the value is valid again: a permutation of the valid values."""
    state = F.struct(value.alias("v"), F.lit(False).alias("done"))
    # A step fails in two thirds of all cases at most; 200 steps in a row practically never.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), state,
        lambda s, _: F.when(s["done"], s).otherwise(let(move(s["v"]), lambda v: F.struct(v.alias("v"), valid(v).alias("done")))),
        lambda s: s["v"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _laid_out(layout: Column, symbols: Column, kind: str = r"[0-9]") -> Column:
    """``layout`` with its symbols replaced, one by one, by those of ``symbols``."""
    gaps = F.split(layout, kind, -1)
    return F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.substr(symbols, i + 1, F.lit(1)))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one counts once."""
    n = F.length(digits)
    return F.aggregate(
        F.transform(_chars(digits), lambda c, i: F.when((n - i) % 2 == 1, c.cast("int")).otherwise(
            F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int")))),
        F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an account number, letters counting 10 to 35."""
    return F.aggregate(_chars(text), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + F.position(c, F.lit(DIGITS)) - 1) % 97).otherwise(
        (acc * 100 + F.position(c, F.lit(UPPER)) + 9) % 97))


def _card(m: Column, key: str, inverse: bool) -> Column:
    def moved(digits: Column) -> Column:
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel(
            F.substr(digits, F.lit(2), F.length(digits) - 2), [DIGITS], key, "card", inverse))
        return let(body, lambda b: F.concat(b, F.pmod(-_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))

    def checked(digits: Column) -> Column:
        return (_luhn_sum(digits) % 10 == 0) & ~digits.rlike(r"^(\d)\1*$")

    def of(digits: Column) -> Column:
        # Sixteen digits with three more behind them, which may be another number: the whole is
        # read first, and a pseudonym of the sixteen never makes the whole pass its check.
        first, rest = F.substr(digits, F.lit(1), F.lit(16)), F.substr(digits, F.lit(17), F.lit(3))
        inner = F.concat(_walk(first, moved, lambda x: _luhn_sum(F.concat(x, rest)) % 10 != 0), rest)
        two = m.rlike(r"^\d{4}(?:[ \-]\d{4}){3}[ \-]\d{3}$")
        return F.when(checked(digits), _laid_out(m, moved(digits))).when(
            two & checked(first), _laid_out(m, inner)).otherwise(m)
    return let(_digits(m), of)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    def of(digits: Column) -> Column:
        # The country code and the first digits of area and exchange, which have rules, stay.
        last = F.right(digits, F.lit(10))
        moved = let(feistel(F.concat(F.substr(last, F.lit(2), F.lit(2)), F.substr(last, F.lit(5), F.lit(6))),
                            [DIGITS], key, "phone", inverse), lambda x: F.concat(
            F.substr(digits, F.lit(1), F.length(digits) - 10), F.substr(last, F.lit(1), F.lit(1)), F.substr(x, F.lit(1), F.lit(2)),
            F.substr(last, F.lit(4), F.lit(1)), F.substr(x, F.lit(3), F.lit(6))))
        short = F.concat(F.substr(digits, F.lit(1), F.lit(2)), feistel(
            F.substr(digits, F.lit(3), F.length(digits)), [DIGITS], key, "phone", inverse))
        return F.when(F.length(digits) >= 10, _laid_out(m, moved)).when(
            F.length(digits) >= 7, _laid_out(m, short)).otherwise(m)
    return let(_digits(m), of)


def _address(m: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    coded = F.array_join(F.transform(F.split(m, r"\."), lambda x: F.lower(F.lpad(F.hex(x.cast("int")), 2, "0"))), "")
    plain = let(feistel(coded, [HEX], key, "address", inverse), lambda h: F.concat_ws(
        ".", *[F.conv(F.substr(h, F.lit(i), F.lit(2)), 16, 10) for i in (1, 3, 5, 7)]))
    return F.when(F.array_max(parts) <= 255, plain).otherwise(m)


def _social(m: Column, key: str, inverse: bool) -> Column:
    def valid(d: Column) -> Column:
        return ~d.rlike(r"^(000|666|9)") & ~d.rlike(r"^...00") & ~d.rlike(r"0000$")
    return let(_digits(m), lambda d: F.when(valid(d), _laid_out(m, _walk(
        d, lambda x: feistel(x, [DIGITS], key, "social", inverse), valid))).otherwise(m))


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def of(plain: Column) -> Column:
        country = F.substr(plain, F.lit(1), F.lit(2))
        body = feistel(F.substr(plain, F.lit(5), F.length(plain)), [DIGITS, UPPER], key, "account", inverse)
        made = let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        ok = _mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1
        return F.when(ok, _laid_out(m, made, "[A-Z0-9]")).otherwise(m)
    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def _date(m: Column, key: str, inverse: bool) -> Column:
    def of(parts: Column) -> Column:
        first = F.length(F.get(parts, F.lit(0))) == 4
        year = F.when(first, F.get(parts, F.lit(0))).otherwise(F.get(parts, F.lit(2)))
        a = F.when(first, F.get(parts, F.lit(2))).otherwise(F.get(parts, F.lit(0)))  # the day, if valid so
        b = F.get(parts, F.lit(1))
        mark = F.regexp_extract(m, r"[-/.]", 0)

        def day(d: Column, mon: Column) -> Column:
            return F.try_to_date(F.concat_ws("-", year, F.lpad(mon, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

        def code(number: Column) -> Column:
            return F.lpad(number.cast("string"), 5, "0")

        def put(found: Column) -> Column:
            # Month before day only where the other order is no date.
            american = ~first & day(a, b).isNull()
            text = F.when(first, F.concat(F.lit("yyyy"), mark, F.lit("MM"), mark, F.lit("dd"))).when(
                american, F.concat(F.lit("MM"), mark, F.lit("dd"), mark, F.lit("yyyy"))).otherwise(
                F.concat(F.lit("dd"), mark, F.lit("MM"), mark, F.lit("yyyy")))
            number = F.datediff(found, F.lit(FIRST_DAY).cast("date"))

            def at(x: Column) -> Column:
                return F.date_add(F.lit(FIRST_DAY).cast("date"), x.cast("int"))

            # A date that only reads as month before day stays one, so no two dates meet.
            moved = _walk(code(number), lambda x: feistel(x, [DIGITS], key, "date", inverse),
                          lambda x: (x.cast("int") < DAYS) & (~american | (F.day(at(x)) > 12)))
            made = at(moved)
            return F.when((number >= 0) & (number < DAYS), F.replace(F.replace(F.replace(
                text, F.lit("yyyy"), F.date_format(made, "yyyy")), F.lit("MM"), F.date_format(made, "MM")),
                F.lit("dd"), F.date_format(made, "dd"))).otherwise(m)

        other = F.when(~first, day(b, a))
        return let(F.coalesce(day(a, b), other), lambda found: F.when(found.isNull(), m).otherwise(put(found)))
    return let(F.split(m, r"[-/.]"), of)


def _email(m: Column, key: str, inverse: bool) -> Column:
    local = F.substring_index(m, "@", 1)
    return F.concat(feistel(local, [DIGITS, LOWER, UPPER], key, "email", inverse), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str, inverse: bool) -> Column:
    label = r"""^(?s)(.*?[=:]\s*["']?)(.*)$"""
    value = F.regexp_extract(m, label, 2)
    moved = let(value, lambda v: F.when(v.rlike("^[0-9a-f]+$"), feistel(v, [HEX], key, "secret", inverse)).otherwise(
        feistel(v, [DIGITS, LOWER, UPPER], key, "secret", inverse)))
    return F.concat(F.regexp_extract(m, label, 1), moved)


def _access(m: Column, key: str, inverse: bool) -> Column:
    return F.concat(F.lit("AKIA"), feistel(F.substr(m, F.lit(5), F.length(m)), [DIGITS + UPPER], key, "access", inverse))


_MAKERS = {"secret": _secret, "access": _access, "email": _email, "iban": _iban, "address": _address,
           "date": _date, "social": _social, "phone": _phone, "card": _card}


def pseudonym(match: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one match of ``PATTERN``; a value that fails its checks is returned as it is."""
    def of(m: Column) -> Column:
        out = F
        for name, shape in SHAPES.items():
            out = out.when(m.rlike(f"^(?:{shape})$"), _MAKERS[name](m, key, inverse))
        return out.otherwise(m)
    return let(match, of)


def pseudonymise_text(text: Column, key: str, inverse: bool = False) -> tuple[Column, Column]:
    """(text with pseudonyms, number of values changed); a null text gives (null, 0)."""
    # Nothing to find without a digit or an at sign, and that test is far cheaper.
    found = F.when(text.rlike(r"[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(
        F.array().cast("array<string>"))

    def rebuilt(pair: Column) -> Column:
        gaps = F.split(text, PATTERN, -1)
        return F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(pair["new"], i), F.lit("")))), "")

    both = let(found, lambda f: F.struct(f.alias("old"), F.transform(f, lambda m: pseudonym(m, key, inverse)).alias("new")))
    result = let(both, lambda pair: F.when(F.size(pair["old"]) == 0, F.struct(text.alias("text"), F.lit(0).cast("bigint").alias("n"))).otherwise(
        F.struct(rebuilt(pair).alias("text"), F.size(F.filter(
            F.arrays_zip(pair["old"], pair["new"]), lambda z: z["old"] != z["new"])).cast("bigint").alias("n"))))
    return result["text"], result["n"]


def pseudonymise(
    docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, inverse: bool = False
) -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``; all other columns and all rows stay.

    Found and checked: card numbers (Luhn), bank accounts (mod 97), social security
    numbers (ranges), calendar dates, IPv4 addresses (octets), phone numbers, e-mail addresses (the part
    before the at sign), access keys, and values of any length, with dots inside too, labelled as password, token or key. Values that
    fail their check stay. ``inverse`` undoes it with the same key. One pass over
    each text in its own partition: no shuffle, no state, no Python.

    A null text stays null and an empty one empty; repeated rows stay repeated and get
    the same pseudonyms; an empty table gives no rows; ``count_col`` names an extra column
    with the number of values changed and replaces one of that name.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text, n = pseudonymise_text(F.col("text"), key, inverse)
    whole = docs.select(row, F.col(f"`{text_col}`").alias("text"))
    # One generated column: both results come from one evaluation.
    made = whole.select("row", F.inline(F.array(F.struct(text.alias("text"), n.alias("n")))))
    keep = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
            for c in docs.columns if c != count_col]
    return made.select(*keep, *([F.col("n").alias(count_col)] if count_col else []))
