"""What printed numbers, packs, dates and boxes say, as column expressions. Null or unreadable input gives null, or an empty list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import amount

#: Characters that one print is read for another, and month names in two languages by their first letters.
CONFUSED = ["568", "068", "17", "38", "S5$", "R5"]
MONTH_STARTS = [["jan"], ["feb", "peb"], ["mar"], ["apr"], ["may", "mei"], ["jun"], ["jul"], ["aug", "agu"], ["sep"], ["oct", "okt"], ["nov", "nop"], ["dec", "des"]]
#: What stands for a value that the paper does not have; units that count as a carton.
NOT_PRINTED = "(not printed)"
CARTONS = ["BOX", "CAR", "CARTON", "CARTONS", "CASE", "CRT", "CS", "CT", "CTN", "CTNS", "DUS", "KARTON", "KRT", "KTN"]


def swaps() -> dict[str, list[str]]:
    """Each character with those it is confused with, in the order of CONFUSED."""
    out: dict[str, list[str]] = {}
    for group in CONFUSED:
        for c in group:
            out.setdefault(c, []).extend(x for x in group if x != c and x not in out.get(c, []))
    return out


def sor_key(value: Column) -> Column:
    """Eleven digits are an order number without its letters; any other value is only cleaned."""
    bare = F.regexp_replace(F.upper(value), "[^0-9A-Z]", "")
    return F.when(bare.rlike("^[0-9]{11}$"), F.concat(F.lit("SOR"), bare)).otherwise(bare)


def typed_number(text: Column) -> Column:
    """The first number in a text, to three decimals."""
    first = F.nullif(F.regexp_extract(text, r"[0-9][0-9.,]*", 0), F.lit(""))
    return F.when(text != NOT_PRINTED, amount(first).cast("decimal(18,3)"))


def pack(text: Column) -> Column:
    """Pieces in a pack: the number after an x between numbers, else the last number."""
    after = F.nullif(F.regexp_extract(text, r"[0-9]+\s*[xX×]\s*([0-9][0-9.,]*)", 1), F.lit(""))
    last = F.element_at(F.regexp_extract_all(text, F.lit(r"[0-9][0-9.,]*"), F.lit(0)), -1)
    found = F.when(F.regexp_count(text, F.lit("[0-9]")) > 0, F.coalesce(after, last))
    return F.when(text != NOT_PRINTED, amount(found).cast("decimal(18,3)"))


def one_number(qty: Column) -> Column:
    """The number of a printed quantity; a pack size (1 x 48) or several numbers are no quantity."""
    q = F.upper(F.coalesce(qty, F.lit("")))
    one = (F.regexp_count(q, F.lit("[0-9][0-9.,]*")) == 1) & ~q.rlike(r"[0-9]\s*[X×]\s*[0-9]")
    return F.when(one, amount(F.regexp_extract(q, "[0-9][0-9.,]*", 0)))


def carton_unit(qty: Column, uom: Column) -> Column:
    """Whether a quantity counts cartons: by the first word beside the number, else in its own column."""
    beside, own = (F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), "[A-Z]+", 0) for c in (qty, uom))
    return F.when(beside != "", beside).otherwise(own).isin(CARTONS)


def pieces(qty: Column, uom: Column, per_carton: Column) -> Column:
    """A printed quantity in pieces; a carton counts as its pieces."""
    n = one_number(qty)
    return F.when(carton_unit(qty, uom), n * F.coalesce(per_carton, F.lit(1.0))).otherwise(n)


def amount_fits(printed: Column, net: Column, vat: Column) -> Column:
    """Whether a printed amount is a line's, net or with tax, within 0.03 % and one rupiah at least; false where the line has none."""
    near = lambda x: F.abs(printed - x) <= F.greatest(F.lit(1.0), x * 0.0003)
    return F.coalesce((net > 0) & (printed != 0) & (near(net) | near(net + F.coalesce(vat, F.lit(0.0)))), F.lit(False))


def price_fits(printed: Column, piece: Column, per_carton: Column) -> Column:
    """Whether a printed unit price is a line's, by piece or carton, with or without 11 % tax, to a whole rupiah; null where none was read."""
    ways = [piece, piece * per_carton]
    return F.greatest(*[(F.abs(printed - w * rate) <= 1).cast("int") for w in ways for rate in (1.0, 1.11)]) == 1


def line_price_fits(printed: Column, piece: Column, outer: Column, per_carton: Column) -> Column:
    """Whether a printed unit price, as text, is a line's, with or without 11 % tax, to a whole rupiah: by piece, or by the outer unit's own price where the line has one, else by as many pieces.
    Null where no price was read."""
    p, pc = amount(printed.cast("string")), F.coalesce(piece, F.lit(0.0))
    whole = F.when(F.coalesce(outer, F.lit(0.0)) != 0, outer).otherwise(pc * F.coalesce(per_carton, F.lit(1.0)))
    return F.greatest(*[(F.abs(p - w * rate) <= 1).cast("int") for w in (pc, whole) for rate in (1.0, 1.11)]) == 1


def alternatives(text: Column) -> Column:
    """Every text that is one misreading away: a character swapped for one it is confused with, a digit dropped or doubled; without the text itself."""
    table = F.create_map(*[x for c, others in swaps().items() for x in (F.lit(c), F.array(*map(F.lit, others)))])
    places = F.sequence(F.lit(1), F.length(text))
    head, at, tail = lambda i: F.substring(text, F.lit(1), i - 1), lambda i: F.substring(text, i, F.lit(1)), lambda i: F.substring(text, i + 1, F.length(text))
    other = lambda i: F.transform(F.coalesce(table[F.upper(at(i))], F.array().cast("array<string>")), lambda c: F.concat(head(i), c, tail(i)))
    digit = lambda i: F.when(at(i).rlike("[0-9]"), F.array(F.concat(head(i), tail(i)), F.concat(head(i), at(i), at(i), tail(i)))).otherwise(F.array().cast("array<string>"))
    found = F.flatten(F.transform(places, lambda i: F.concat(other(i), digit(i))))
    return F.when(F.length(text) > 0, F.array_remove(F.array_distinct(found), text)).otherwise(F.array().cast("array<string>"))


def other_mark(text: Column) -> Column:
    """The text with its last mark read as the other one, comma for dot or dot for comma; none without a mark."""
    at = F.length(text) - F.length(F.regexp_extract(text, "[.,]([^.,]*)$", 1))
    swapped = F.concat(F.substring(text, F.lit(1), at - 1), F.translate(F.substring(text, at, F.lit(1)), ".,", ",."), F.substring(text, at + 1, F.length(text)))
    return F.when(F.rlike(text, F.lit("[.,]")), F.array(swapped)).otherwise(F.array().cast("array<string>"))


def trigrams(text: Column) -> Column:
    """The distinct three-character pieces of a text with two blanks before and one after, lower case."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(trigrams(a), trigrams(b))) / F.size(F.array_union(trigrams(a), trigrams(b)))


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of boxes [left, top, right, bottom]; 0 where they are apart."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    both = side(0, 2) * side(1, 3)
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def percents_agree(a: Column, b: Column) -> Column:
    """Whether two lists of discounts are the same but for their order, zeros and the third decimal."""
    clean = lambda c: F.array_sort(F.transform(F.filter(c, lambda x: x != 0), lambda x: F.round(x, 2)))
    return clean(a) == clean(b)


def named_day(text: Column) -> Column:
    """The day in a text such as 17 Agustus 26 or 5-Oct-2026: a two-figure year is of this century; an impossible day is null."""
    pattern = r"([0-9]{1,2})[\s./-]+([A-Za-z]{3})[A-Za-z]*[\s./,-]+([0-9]{4}|[0-9]{2})\b"
    day, name, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    month = F.coalesce(*[F.when(F.lower(name).isin(names), F.lit(n)) for n, names in enumerate(MONTH_STARTS, 1)])
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.concat_ws("-", full, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def seconds_until(text: Column) -> Column:
    """1h2m3.5s in seconds; a text with none of the three is null."""
    part = lambda unit: F.nullif(F.regexp_extract(text, rf"([0-9]+(?:\.[0-9]+)?){unit}\b|([0-9]+(?:\.[0-9]+)?){unit}[0-9]", 0), F.lit(""))
    number = lambda unit: F.regexp_extract(part(unit), r"[0-9]+(?:\.[0-9]+)?", 0).cast("double")
    h, m, s = number("h"), number("m"), number("s")
    return F.when(F.coalesce(h, m, s).isNotNull(), F.coalesce(h, F.lit(0.0)) * 3600 + F.coalesce(m, F.lit(0.0)) * 60 + F.coalesce(s, F.lit(0.0)))
